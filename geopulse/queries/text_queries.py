"""Text functions, models and scores."""

from pyspark.sql import functions as F

from geopulse.constants import SCORE_LABELS
from geopulse.functions import scalars, text
from geopulse.operators import language, sentiment
from geopulse.operators import lemmas as lemma_rules
from geopulse.queries.registry import (
    SQL_LEMMAS, SQL_LEXICON, SQL_PROFILES, S, W, lemmas, lexicon, literal_table, query, sql_bin, sql_compound,
    sql_content, sql_detect, sql_place, sql_round, sql_strip, sql_tokens, values_sql,
)

DECORATED = "text || ' @' || source || ' #' || lang || 'é http://x.org/' || doc_id || '?q=1 end'"


@query("strip_social", f"SELECT doc_id, {sql_strip(DECORATED)} AS stripped FROM documents")
def strip_social(t):
    return t.documents.select("doc_id", text.strip_social(F.expr(DECORATED)).alias("stripped"))


@query(
    "normalise_location",
    "SELECT c_custkey, " + sql_place("lower(c_name || ', ' || n_name || ' - (Victoria) ' || r_name)")
    + " AS place, string_split(" + sql_place("lower(n_name || '  South Australia')") + ", ' ')[1] AS first_word "
    "FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
)
def normalise_location(t):
    joined = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(
        t.region, F.col("n_regionkey") == F.col("r_regionkey")
    )
    place = F.lower(F.expr("c_name || ', ' || n_name || ' - (Victoria) ' || r_name"))
    short = text.normalise_location(F.lower(F.expr("n_name || '  South Australia'")))
    return joined.select(
        "c_custkey",
        text.normalise_location(place).alias("place"),
        scalars.key_part(text.split_words(short)).alias("first_word"),
    )


@query(
    "word_subsequences",
    """WITH p AS (SELECT p_partkey, string_split(p_name || ' ' || lower(p_type) || ' ' || p_size, ' ') AS w FROM part),
    m AS (SELECT p_partkey, w, unnest(range(1, CAST(pow(2, len(w)) AS BIGINT))) AS mask FROM p),
    b AS (SELECT p_partkey, mask, w, unnest(range(0, len(w))) AS i FROM m),
    c AS (SELECT p_partkey, mask, string_agg(w[i + 1], ' ' ORDER BY i) AS text, count(*) AS n,
                 string_agg(lpad(CAST(i AS VARCHAR), 3, '0'), ',' ORDER BY i) AS places
          FROM b WHERE (mask >> i) & 1 = 1 GROUP BY p_partkey, mask)
    SELECT p_partkey, string_agg(text, '/' ORDER BY n, places) AS candidates FROM c GROUP BY p_partkey""",
)
def word_subsequences(t):
    place = F.expr("p_name || ' ' || lower(p_type) || ' ' || p_size")
    return t.part.select(
        "p_partkey", F.array_join(text.word_subsequences(place), "/").alias("candidates")
    )


@query(
    "place_names",
    """WITH n AS (SELECT p_partkey, replace(replace(replace(replace(
         p_name || ' - (' || p_brand || ') st.', '(', ''), ')', ''), ' - ', ' '), '.', '') AS location FROM part),
    w AS (SELECT p_partkey, location, string_split(location, ' ') AS w FROM n),
    b AS (SELECT p_partkey, w, unnest(range(1, len(w))) AS i FROM w WHERE len(w) > 2),
    j AS (SELECT p_partkey, string_agg(w[i] || ' ' || w[i + 1], '/' ORDER BY i) AS bigrams FROM b GROUP BY p_partkey)
    SELECT n.p_partkey, location, bigrams FROM n LEFT JOIN j ON n.p_partkey = j.p_partkey""",
)
def place_names(t):
    name = text.place_name(F.expr("p_name || ' - (' || p_brand || ') st.'"))
    return t.part.select("p_partkey", name.alias("location")).select(
        "p_partkey", "location", F.array_join(text.name_bigrams("location"), "/").alias("bigrams")
    )


def sql_page_text(x):
    x = f"regexp_replace({x}, '(?s)<!--.*?-->', chr(57344), 'g')"
    for tag in ("script", "style", "template", "rt", "rp"):
        x = rf"regexp_replace({x}, '(?is)<{tag}(?:\s[^>]*)?>.*?</{tag}\s*>', chr(57344), 'g')"
    x = f"regexp_replace({x}, '(?s)<[!/?a-zA-Z][^>]*>', chr(57344), 'g')"
    for name, char in [
        ("lt", "<"), ("gt", ">"), ("quot", '"'), ("copy", "©"), ("middot", "·"), ("nbsp", "\xa0"),
        ("eacute", "é"), ("amp", "&"),
    ]:
        x = rf"regexp_replace({x}, '&{name};', '{char}', 'g')"
        x = rf"regexp_replace({x}, '&{name}([^a-zA-Z0-9]|$)', '{char}\1', 'g')"
    return f"replace({x}, chr(57344), '')"


# References that pages of these tables lack, and what they stand for.
REFERENCES = "<p>&#0000000065;&#x00000042; &#9999999; &#0;&#xD800;&#128;&notit;&hearts;&#"
REFERENCE_TEXT = "AB \ufffd \ufffd\ufffd€¬it;♥"


@query(
    "html_to_text",
    f"SELECT page_id, {sql_page_text('html')} || '{REFERENCE_TEXT}' || chr(CAST(65 + page_id % 26 AS INTEGER)) AS text FROM pages",
)
def html_to_text(t):
    page = F.concat("html", F.lit(REFERENCES), (65 + F.col("page_id") % 26).cast("string"), F.lit(";</p>"))
    return t.pages.select("page_id", text.html_to_text(page).alias("text"))


@query(
    "normalise_text",
    f"""WITH {SQL_LEMMAS}, {sql_content('documents', 'doc_id', 'text')}
    SELECT doc_id, content FROM content""",
)
def normalise_text(t):
    out = sentiment.normalise_text(t.documents, "text", lemmas(t.spark), ["doc_id"])
    return out.select("doc_id", "content")


# A dictionary of the texts' own words, so that rules find something at every scale, and some exceptions.
EXCEPTIONS = [("des", "de"), ("les", "el"), ("les", "la"), ("is", "be"), ("was", "wa"), ("women", "woman")]
SQL_RULES = values_sql(lemma_rules.NOUN_RULES, ["old", "new"], "rules")


def sql_lemmatised():
    return rf"""WITH RECURSIVE {values_sql(EXCEPTIONS, ["token", "lemma"], "exc")}, {SQL_RULES},
    tk AS (SELECT doc_id, unnest({sql_tokens('text')}) AS t, generate_subscripts({sql_tokens('text')}, 1) AS pos FROM documents),
    tokens AS (SELECT DISTINCT t FROM tk),
    words AS (SELECT t AS word FROM tokens WHERE (ascii(t) + length(t)) % 3 > 0),
    forms(t, form, level) AS (SELECT t, t, 0 FROM tokens WHERE t NOT IN (SELECT token FROM exc)
        UNION SELECT t, substr(form, 1, length(form) - length(old)) || new, level + 1 FROM forms JOIN rules ON ends_with(form, old)),
    cands AS (SELECT t, form, greatest(level, 1) AS level FROM forms
        UNION SELECT t, t, 1 FROM tokens WHERE t IN (SELECT token FROM exc)
        UNION SELECT token, lemma, 1 FROM exc),
    best AS (SELECT t, form AS lemma FROM (SELECT t, form,
        row_number() OVER (PARTITION BY t ORDER BY level, length(form), form <> t, form) AS rk FROM cands JOIN words ON form = word) WHERE rk = 1)
    SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(j.content, '') END AS content FROM documents d LEFT JOIN (
        SELECT doc_id, string_agg(coalesce(lemma, tk.t), ' ' ORDER BY pos) AS content FROM tk LEFT JOIN best ON tk.t = best.t GROUP BY doc_id) j
    ON d.doc_id = j.doc_id"""


def own_words(t):
    """About two of three distinct tokens."""
    tokens = t.documents.select(F.explode(text.tokenise("text")).alias("word")).distinct()
    return tokens.where((F.ascii("word") + F.length("word")) % 3 > 0)


@query("lemmatise_rules", sql_lemmatised())
def lemmatise_rules(t):
    exceptions = literal_table(t.spark, EXCEPTIONS, ["token", "lemma"])
    model = lemma_rules.RuleLemmatiser(own_words(t), exceptions)
    return model.normalise(t.documents, "text", ["doc_id"]).select("doc_id", "content")


@query(
    "train_lang",
    f"WITH {SQL_PROFILES} SELECT lang, gram, weight FROM profiles",
)
def train_lang(t):
    return language.train_lang(t.documents, "text", "lang")


@query(
    "detect_lang",
    f"""WITH {SQL_PROFILES}, {sql_detect('documents', 'doc_id', 'text')}
    SELECT d.doc_id, x.lang AS lang FROM documents d LEFT JOIN detected x ON d.doc_id = x.doc_id""",
)
def detect_lang(t):
    profiles = language.train_lang(t.documents, "text", "lang")
    posts = t.documents.select("doc_id", "text")
    return language.detect_lang(posts, "text", profiles, ["doc_id"]).select("doc_id", "lang")


@query(
    "lang_accuracy",
    f"""WITH {SQL_PROFILES}, {sql_detect('documents', 'doc_id', 'text')}
    SELECT d.lang AS lang, count(*) AS posts, CAST(sum(CASE WHEN x.lang = d.lang THEN 1 ELSE 0 END) AS BIGINT) AS "right"
    FROM documents d LEFT JOIN detected x ON d.doc_id = x.doc_id GROUP BY d.lang""",
)
def lang_accuracy(t):
    profiles = language.train_lang(t.documents, "text", "lang")
    posts = t.documents.select("doc_id", "text", "lang")
    found = language.detect_lang(posts, "text", profiles, ["doc_id"], out="found")
    return found.groupBy("lang").agg(
        F.count("*").alias("posts"), F.count(F.when(F.col("found") == F.col("lang"), 1)).alias("right")
    )


@query(
    "polarity",
    f"""WITH {SQL_LEMMAS}, {SQL_LEXICON}, {sql_content('documents', 'doc_id', 'text')},
    {sql_compound('content', 'doc_id')}
    SELECT doc_id, round(compound, 9) AS compound, {sql_bin('compound')} AS score FROM polar""",
)
def polarity(t):
    posts = sentiment.normalise_text(t.documents, "text", lemmas(t.spark), ["doc_id"])
    scored = sentiment.polarity(posts, "content", lexicon(t.spark), ["doc_id"])
    return scored.select(
        "doc_id", F.round("compound", 9).alias("compound"), scalars.score_bin("compound").alias("score")
    )


# Frequent words turned into boosters and negators, so that every rule fires on the given texts.
_VARIED = (
    r"trim(regexp_replace(replace(replace(replace(replace(lower(text), ' in ', ' not '), ' for ', ' very '), "
    r"' de ', ' barely '), ' en ', ' never '), '[\s\x0b\p{Z}\x1c-\x1f\x85]+', ' ', 'g'))"
)


def sql_polarity_rules(lexicon=SQL_LEXICON, source="documents", key="doc_id"):
    boosters = ", ".join(f"('{w}', {s})" for w, s in sentiment.BOOSTERS.items())
    negators = ", ".join(f"'{w}'" if w != "n't" else "'n''t'" for w in sentiment.NEGATORS)
    lags = ", ".join(
        f"lag(w, {k}) OVER (PARTITION BY {key} ORDER BY pos) AS p{k}, "
        f"lag(valence, {k}) OVER (PARTITION BY {key} ORDER BY pos) AS v{k}" for k in (1, 2, 3)
    )
    boost = " + ".join(
        f"CASE WHEN v{k} IS NULL AND b{k}.s IS NOT NULL THEN b{k}.s * sign(valence) * {micro * 100} ELSE 0 END"
        for k, micro in enumerate(sentiment.BOOST_MICRO, 1)
    )
    joins = " ".join(f"LEFT JOIN boosters b{k} ON b{k}.w = p{k}" for k in (1, 2, 3))
    damp = " * ".join(
        f"CASE WHEN v{k} IS NULL AND p{k} IN ({negators}) THEN -0.74 ELSE 1.0 END" for k in (1, 2, 3)
    )
    return f"""WITH {lexicon}, boosters(w, s) AS (VALUES {boosters}),
    t AS (SELECT {key}, unnest(regexp_extract_all(lower(text), '[^ ]+')) AS w,
                 generate_subscripts(regexp_extract_all(lower(text), '[^ ]+'), 1) AS pos FROM
          (SELECT {key}, {_VARIED} AS text FROM {source})),
    v AS (SELECT {key}, pos, t.w, valence FROM t LEFT JOIN lexicon ON t.w = token),
    n AS (SELECT {key}, pos, valence, {lags} FROM v),
    x AS (SELECT {key}, (valence * 10000000 + {boost}) / 100000000.0 * {damp} AS y
          FROM n {joins} WHERE valence IS NOT NULL),
    s AS (SELECT {key}, sum(y) AS s0 FROM x GROUP BY {key})
    SELECT d.{key}, round(coalesce(s0, 0) / sqrt(coalesce(s0, 0) * coalesce(s0, 0) + 15.0), 6) AS compound
    FROM {source} d LEFT JOIN s ON d.{key} = s.{key}"""


def varied(text):
    out = F.lower(text)
    for word, other in [("in", "not"), ("for", "very"), ("de", "barely"), ("en", "never")]:
        out = F.replace(out, F.lit(f" {word} "), F.lit(f" {other} "))
    return F.trim(F.regexp_replace(out, rf"[{S}]+", " "))


@query("polarity_rules", sql_polarity_rules())
def polarity_rules(t):
    posts = t.documents.select("doc_id", varied("text").alias("content"))
    scored = sentiment.polarity(posts, "content", lexicon(t.spark), ["doc_id"], rules=True)
    return scored.select("doc_id", F.round("compound", 6).alias("compound"))


# Phrases of words that are frequent in the texts; none begins with another's end.
PHRASES = [("und die", -25), ("not the", 13), ("der und", 8), ("very la que", 31), ("and to is", -9)]
# Some words in capitals, marks at the end, and a contrast.
SHOUTED = (
    "replace(replace(replace({x}, ' and ', ' AND '), ' la ', ' LA '), ' la. ', ' but ') || repeat('!', {n} % 6) || repeat('?', {n} % 5)"
)
PUNCTUATION_SQL = sentiment.PUNCTUATION.replace("'", "''")


def sql_polarity_full():
    boosters = ", ".join(f"('{w}', {s})" for w, s in sentiment.BOOSTERS.items())
    negators = ", ".join(f"'{w}'" if w != "n't" else "'n''t'" for w in sentiment.NEGATORS)
    lags = ", ".join(
        f"lag(CASE WHEN v IS NULL AND free THEN lw END, {k}) OVER o AS p{k}, lag(caps, {k}) OVER o AS c{k}" for k in (1, 2, 3)
    )
    boost = " + ".join(
        f"CASE WHEN b{k}.s IS NOT NULL THEN sign(v) * (b{k}.s * {boost / 1e6} + CASE WHEN c{k} THEN {caps / 1e6} ELSE 0 END) ELSE 0 END"
        for k, (boost, caps) in enumerate(zip(sentiment.BOOST_MICRO, sentiment.CAPITALS_MICRO), 1)
    )
    joins = " ".join(f"LEFT JOIN boosters b{k} ON b{k}.w = p{k}" for k in (1, 2, 3))
    damp = " * ".join(f"CASE WHEN p{k} IN ({negators}) THEN -0.74 ELSE 1.0 END" for k in (1, 2, 3))
    return rf"""WITH {SQL_LEXICON}, {values_sql(PHRASES, ["phrase", "valence"], "phrases")}, boosters(w, s) AS (VALUES {boosters}),
    src AS (SELECT doc_id, {SHOUTED.format(x=_VARIED, n="doc_id")} AS text FROM documents),
    cut AS (SELECT doc_id, text, list_transform(regexp_extract_all(text, '[^ 	

]+'),
        lambda w: CASE WHEN length(trim(w, '{PUNCTUATION_SQL}')) > 2 THEN trim(w, '{PUNCTUATION_SQL}') ELSE w END) AS ws FROM src),
    info AS (SELECT doc_id, list_position(list_transform(ws, lambda w: lower(w)), 'but') AS contrast,
        len(list_filter(ws, lambda w: upper(w) = w AND lower(w) <> w)) AS n_caps, len(ws) AS n,
        least(length(text) - length(replace(text, '!', '')), 4) * 0.292 + CASE WHEN length(text) - length(replace(text, '?', '')) < 2 THEN 0
        WHEN length(text) - length(replace(text, '?', '')) <= 3 THEN (length(text) - length(replace(text, '?', ''))) * 0.18 ELSE 0.96 END AS emphasis FROM cut),
    tk AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM cut),
    g AS (SELECT *, lower(w) AS lw, lead(lower(w), 1) OVER o AS n1, lead(lower(w), 2) OVER o AS n2 FROM tk WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
    ph AS (SELECT g.*, t.valence AS v3, u.valence AS v2, CASE WHEN t.phrase IS NOT NULL THEN 3 WHEN u.phrase IS NOT NULL THEN 2 ELSE 0 END AS m
        FROM g LEFT JOIN phrases t ON t.phrase = lw || ' ' || n1 || ' ' || n2 LEFT JOIN phrases u ON u.phrase = lw || ' ' || n1),
    cov AS (SELECT *, coalesce(lag(m, 1) OVER o > 1, false) OR coalesce(lag(m, 2) OVER o > 2, false) AS inside FROM ph WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
    val AS (SELECT c.doc_id, pos, lw, NOT inside AND m = 0 AND l.valence IS NULL AS free, CASE WHEN inside THEN NULL WHEN m > 0 THEN coalesce(v3, v2) ELSE l.valence END AS v,
        n_caps > 0 AND n_caps < n AND upper(w) = w AND lower(w) <> w AS caps, contrast, emphasis
        FROM cov c LEFT JOIN lexicon l ON l.token = lw JOIN info i ON i.doc_id = c.doc_id),
    near AS (SELECT *, {lags} FROM val WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
    x AS (SELECT doc_id, (v / 10.0 + CASE WHEN caps THEN sign(v) * 0.733 ELSE 0 END + {boost}) * {damp}
        * CASE WHEN coalesce(contrast, 0) = 0 OR pos = contrast THEN 1 WHEN pos < contrast THEN 0.5 ELSE 1.5 END AS y FROM near {joins} WHERE v IS NOT NULL),
    s AS (SELECT i.doc_id, coalesce(s0, 0) + sign(coalesce(round(s0, 7), 0)) * emphasis AS s0 FROM info i LEFT JOIN (SELECT doc_id, sum(CAST(y AS DOUBLE)) AS s0 FROM x GROUP BY doc_id) y ON i.doc_id = y.doc_id)
    SELECT doc_id, round(s0 / sqrt(s0 * s0 + 15.0), 5) AS compound FROM s"""


@query("polarity_full", sql_polarity_full())
def polarity_full(t):
    shouted = F.expr(SHOUTED.format(x="content", n="CAST(doc_id AS INT)"))
    posts = t.documents.select("doc_id", varied("text").alias("content")).select("doc_id", shouted.alias("content"))
    phrases = literal_table(t.spark, PHRASES, ["phrase", "valence"])
    scored = sentiment.FullScorer(lexicon(t.spark), phrases).score(posts, "content", ["doc_id"])
    return scored.select("doc_id", F.round("compound", 5).alias("compound"))


# --- the same with models that are joined: derived from the words of the texts, ids that repeat ------
SQL_COPIES = """posts AS (SELECT doc_id || '/' || copy AS k, * FROM (
    SELECT doc_id, 0 AS copy, text FROM documents UNION ALL
    SELECT doc_id, 1, text || ' again the others' FROM documents WHERE doc_id % 3 = 0 UNION ALL
    SELECT doc_id, 2, text FROM documents WHERE doc_id % 5 = 0))"""
SQL_LARGE_LEMMAS = f"""lemmas AS (SELECT token, substr(token, 1, 4) AS lemma
    FROM (SELECT DISTINCT unnest({sql_tokens('text')}) AS token FROM documents) WHERE regexp_full_match(token, '[a-z]{{6,}}'))"""
SQL_LARGE_LEXICON = """lexicon AS (SELECT token, CAST((ascii(token) + 3 * ascii(substr(token, 2))) % 9 - 4 AS BIGINT) AS valence
    FROM (SELECT DISTINCT unnest(string_split(lower(text), ' ')) AS token FROM documents) WHERE regexp_full_match(token, '[a-z]{2,6}'))"""


def copies(t):
    """Texts of which many share their id with another, equal or different one."""
    d = t.documents.select("doc_id", F.lit(0).alias("copy"), "text")
    other = d.where("doc_id % 3 = 0").select("doc_id", F.lit(1).alias("copy"), F.concat("text", F.lit(" again the others")).alias("text"))
    return d.unionByName(other).unionByName(d.where("doc_id % 5 = 0").withColumn("copy", F.lit(2)))


def large_lemmas(t):
    """A lemma for every longer word; some stand twice, with a lemma that comes later in order."""
    token = t.documents.select(F.explode(text.tokenise("text")).alias("token")).distinct()
    token = token.where(F.rlike("token", F.lit("^[a-z]{6,}$")))
    # The texts are read once.
    first, other = F.substring("token", 1, 4), F.lit("zz")
    return token.select("token", F.explode(F.when(F.col("token").startswith("t"), F.array(first, other)).otherwise(F.array(first))).alias("lemma"))


def large_lexicon(t):
    token = t.documents.select(F.explode(F.split(F.lower("text"), " ")).alias("token")).distinct()
    token = token.where(F.rlike("token", F.lit("^[a-z]{2,6}$")))
    value = ((F.ascii("token") + 3 * F.ascii(F.substring("token", 2, 1))) % 9 - 4).cast("int")
    return token.select("token", F.explode(F.when(F.col("token").startswith("t"), F.array(value, F.lit(9))).otherwise(F.array(value))).alias("valence"))


@query(
    "normalise_text_joined",
    f"WITH {SQL_COPIES}, {SQL_LARGE_LEMMAS}, {sql_content('posts', 'k', 'text')} "
    "SELECT doc_id, copy, content FROM posts JOIN content ON posts.k = content.k",
)
def normalise_text_joined(t):
    out = sentiment.normalise_text(copies(t), "text", large_lemmas(t), ["doc_id"], max_rows=0)
    return out.select("doc_id", "copy", "content")


@query(
    "polarity_joined",
    f"WITH {SQL_COPIES}, {SQL_LARGE_LEXICON}, {sql_compound('posts', 'k', 'text')} "
    "SELECT doc_id, copy, round(compound, 9) AS compound FROM posts JOIN polar ON posts.k = polar.k",
)
def polarity_joined(t):
    scored = sentiment.polarity(copies(t), "text", large_lexicon(t), ["doc_id"], max_rows=0)
    return scored.select("doc_id", "copy", F.round("compound", 9).alias("compound"))


@query(
    "polarity_rules_joined",
    "WITH " + SQL_COPIES + ", found AS (" + sql_polarity_rules(SQL_LARGE_LEXICON, "posts", "k") + ") "
    "SELECT doc_id, copy, compound FROM posts JOIN found ON posts.k = found.k",
)
def polarity_rules_joined(t):
    posts = copies(t).withColumn("content", varied("text"))
    scored = sentiment.polarity(posts, "content", large_lexicon(t), ["doc_id"], rules=True, max_rows=0)
    return scored.select("doc_id", "copy", F.round("compound", 6).alias("compound"))


@query(
    "detect_lang_joined",
    f"WITH {SQL_PROFILES}, {SQL_COPIES}, {sql_detect('posts', 'k', 'text')} "
    "SELECT doc_id, copy, x.lang AS lang FROM posts LEFT JOIN detected x ON posts.k = x.k",
)
def detect_lang_joined(t):
    profiles = language.train_lang(t.documents, "text", "lang")
    return language.detect_lang(copies(t), "text", profiles, ["doc_id"], max_rows=0).select("doc_id", "copy", "lang")


SCALED = "value / 250.0 - 1.0"


@query(
    "score_bins",
    f"""WITH s AS (SELECT event_id, {sql_bin('(' + SCALED + ')')} AS score FROM events)
    SELECT event_id, score, CASE score """
    + " ".join(f"WHEN {k} THEN '{v}'" for k, v in SCORE_LABELS.items())
    + " ELSE 'Invalid score' END AS label FROM s",
)
def score_bins(t):
    binned = t.events.select("event_id", scalars.score_bin(F.expr(SCALED)).alias("score"))
    return binned.withColumn("label", scalars.score_label("score"))


@query(
    "score_histogram",
    f"""WITH s AS (SELECT event_type, {sql_bin('(' + SCALED + ')')} AS score FROM events),
    k AS (SELECT event_type, CAST(score AS INTEGER) AS score FROM (SELECT DISTINCT event_type FROM events), range(1, 10) r(score)),
    c AS (SELECT event_type, score, count(*) AS n FROM s GROUP BY event_type, score)
    SELECT k.event_type, k.score, coalesce(n, 0) AS "count" FROM k LEFT JOIN c
    ON k.event_type = c.event_type AND k.score = c.score""",
)
def score_histogram(t):
    scored = t.events.withColumn("score", scalars.score_bin(F.expr(SCALED)))
    return sentiment.score_histogram(scored, by=["event_type"])


@query(
    "round_two_digits",
    f"SELECT l_returnflag, l_linenumber, {sql_round('sum(CAST(l_quantity AS BIGINT)) / count(*)')} AS mean "
    "FROM lineitem GROUP BY l_returnflag, l_linenumber",
)
def round_two_digits(t):
    mean = F.sum(F.col("l_quantity").cast("bigint")) / F.count("*")
    return t.lineitem.groupBy("l_returnflag", "l_linenumber").agg(
        scalars.round_half_even(mean).alias("mean")
    )


@query(
    "local_dates",
    """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.000Z') AS iso,
       strftime(CAST(ts + INTERVAL 11 HOUR AS DATE), '%Y-%m-%d') AS local_date FROM events""",
)
def local_dates(t):
    return t.events.select(
        "event_id",
        scalars.iso_utc("ts").alias("iso"),
        # The tables lie within daylight saving time of this zone (UTC+11).
        scalars.local_date("ts", "Australia/Melbourne").cast("string").alias("local_date"),
    )


@query(
    "local_dates_over_years",
    """SELECT o_orderkey, strftime(CAST(timezone('Australia/Melbourne',
       timezone('UTC', o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)))) AS DATE), '%Y-%m-%d') AS local_date FROM orders""",
)
def local_dates_over_years(t):
    """Hours of several years, so with and without daylight saving time."""
    hours = F.make_interval(hours=(F.col("o_orderkey") % 24).cast("int"))
    local = scalars.local_date(F.col("o_orderdate") + hours, "Australia/Melbourne")
    return t.orders.select("o_orderkey", local.cast("string").alias("local_date"))


@query(
    "tag_lists",
    """SELECT user_id, string_agg(DISTINCT event_type, '|' ORDER BY event_type) AS tags,
       count(DISTINCT event_type) AS n, min(event_type) AS first_tag FROM events GROUP BY user_id""",
)
def tag_lists(t):
    tagged = t.events.groupBy("user_id").agg(
        text.join_tags(F.array_sort(F.collect_set("event_type"))).alias("tags")
    )
    split = text.split_tokens("tags")
    return tagged.select(
        "user_id", "tags", F.size(split).cast("bigint").alias("n"), scalars.key_part(split).alias("first_tag")
    )


@query("text_contains", "SELECT doc_id FROM documents WHERE contains(text, 'ation')")
def text_contains(t):
    from geopulse.operators.filters import contains

    return contains(t.documents, "text", "ation").select("doc_id")
