"""Operators that read each text by itself: BPE, license rules, quality rules, language, extraction."""

import base64
import hashlib
import html as references
import re
import zlib

import duckdb
import numpy as np
import pytest
import tiktoken

from geopulse.llm import byte_bpe, host_paths, lang_conv, license_rules, quality_rules
from geopulse.llm.queries import ORACLES, QUERIES
from oracle import compare, connect

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_bpe_equals_tiktoken_and_round_trips(docs, odd_texts):
    path, pattern = byte_bpe.vocabulary()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    df = docs(odd_texts)
    for r in byte_bpe.round_trip(df, path, pattern).collect():
        text = odd_texts[r.doc_id] or ""
        ids = library.encode_ordinary(text)
        assert r.n_tokens == len(ids) and r.whole
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    encoded = byte_bpe.encode(df, path, pattern, offsets=True)
    for r in encoded.collect():
        text = odd_texts[r.doc_id] or ""
        assert r.ids == library.encode_ordinary(text)
        # Spans go on from each other and cover the text; a split character is in the span of each part.
        spans = list(zip(r.starts, r.ends))
        assert all(a[0] <= b[0] <= a[1] <= b[1] for a, b in zip(spans, spans[1:]))
        assert not text or (r.starts[0] == 0 and r.ends[-1] == len(text))
    for r in byte_bpe.decode(encoded, path, pattern).collect():
        assert bytes(r.decoded).decode() == (odd_texts[r.doc_id] or "")
    assert byte_bpe.round_trip(df.limit(0), path, pattern).count() == 0


def test_bpe_random_pieces_equal_tiktoken():
    import random

    path, pattern = byte_bpe.vocabulary()
    tool = byte_bpe.codec(path, pattern)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    random.seed(1)
    parts = ["a", "aa", "-", "  ", "\n", "\x1c", "\x85", "é", "日", "😀", "́", "1", "²", "'s", " ", "=", "__", "​", "ß", "!!"]
    for _ in range(3000):
        text = "".join(random.choice(parts) * random.choice([1, 1, 2, 5]) for _ in range(random.randint(0, 20)))
        assert tool.encode(text).tolist() == library.encode_ordinary(text)
        assert tool.encode_with_offsets(text)[0] == library.encode_ordinary(text)


def base_scan(text):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(low))
    places, labels = [], set()
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        phrase = phrase.split()
        hits = [i for i in range(len(words)) if words[i : i + len(phrase)] == phrase]
        places += hits
        labels |= {label} if hits else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


LICENSE_TEXTS = [
    "Licensed under CC BY-NC 4.0.", "Released under the MIT License. MIT License, mit-license",
    "GNU Lesser General Public License v2.1 or the GNU General Public License, version 3.",
    "SPDX-License-Identifier: Apache-2.0", "All rights reserved.", "Apache License, Version 2.0", "xmit license",
]


def test_license_base_equals_brute_force(docs, odd_texts):
    texts = odd_texts + LICENSE_TEXTS
    got = {r.doc_id: r for r in license_rules.scan(docs(texts)).collect()}
    for i, text in enumerate(texts):
        firsts = [d["first"] for d in got[i]["base"]]
        n, places, first, last, _ = base_scan(text)
        assert (got[i].n_words, len(firsts)) == (n, places)
        assert (min(firsts, default=None), max(firsts, default=None)) == (first, last)


def test_license_containment_and_priority(docs):
    got = {r.doc_id: {d["label"] for d in r["detections"]} for r in license_rules.scan(docs(LICENSE_TEXTS)).collect()}
    assert got[0] == {"cc-by-nc-4.0"}
    assert got[2] == {"lgpl-2.1", "gpl-3"}
    assert got[3] == {"apache-2.0"}
    assert got[6] == set()
    # Brute force over intervals.
    random = np.random.default_rng(5)
    for _ in range(300):
        found = [("x", int(a), int(a + b), int(p), 1.0, i) for i, (a, b, p) in enumerate(random.integers(0, 6, (8, 3)))]
        best = {}
        for d in found:
            best.setdefault(d[1:4], d)

        def beaten(d):
            return any(
                e is not d and e[1] <= d[1] and e[2] >= d[2] and e[3] >= d[3] and (e[1:4] != d[1:4] or e[5] < d[5]) for e in found
            )

        assert sorted(license_rules.outermost(found)) == sorted(d[:5] for d in found if not beaten(d))


def matching(parsed, k):
    """A text that a parsed pattern matches, taking the k-th choice wherever there is one."""
    out = ""
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            out += chr(arg)
        elif name == "IN":
            kind, value = arg[k % len(arg)]
            out += chr(value if str(kind) == "LITERAL" else value[0] + k % (value[1] - value[0] + 1))
        elif name == "BRANCH":
            out += matching(arg[1][k % len(arg[1])], k // len(arg[1]))
        elif name == "SUBPATTERN":
            out += matching(arg[3], k)
        elif name == "MAX_REPEAT":
            out += matching(arg[2], k) * (arg[0] + k % (min(arg[1], arg[0] + 2) - arg[0] + 1))
        else:
            assert name == "ASSERT_NOT", name
    return out


def test_license_keywords_let_every_alternative_through():
    scanner = license_rules.Scanner()
    texts = {matching(re._parser.parse(r.pattern.pattern), k) for r in scanner.rules for k in range(24)}
    assert len(texts) > 3000
    for text in sorted(texts):
        line, every = text.encode(), []
        for i, rule in enumerate(scanner.rules):
            for m in rule.pattern.finditer(line):
                first, last = line.count(b" ", 0, m.start()), line.count(b" ", 0, m.end() - 1)
                every.append((rule.label, first, last, rule.priority, rule.weight, i))
        assert every and scanner.scan(text)[2] == license_rules.outermost(every), text


def test_license_abbreviations_with_versions():
    scanner = license_rules.Scanner()

    def labels(text):
        return {d[0] for d in scanner.scan(text)[2]}

    cases = {
        "GPLv3 or later": "gpl-abbreviation-3", "GNU GPL v2": "gpl-abbreviation-2", "under GPL-3.0-only": "gpl-abbreviation-3.0", "LGPLv2.1": "lgpl-2.1", "LGPL 3": "lgpl-3",
        "AGPLv3": "agpl-3", "MPL-2.0": "mpl-2.0", "EPL 1.0": "epl-1.0", "Apache-2.0": "apache-2.0", "GFDL1.3": "gfdl-1.3",
        "SPDX-License-Identifier: LGPL-2.1-or-later": "lgpl-2.1", "SPDX-License-Identifier: MPL-2.0": "mpl-2.0", "EUPL v1.2": "eupl-1.2",
    }
    for text, label in cases.items():
        assert labels(text) == {label}, text
    assert labels("xgplv3 gplv9 mpl 9 0 apaches 2 0") == set()


def test_license_names_without_their_usual_words():
    scanner = license_rules.Scanner()

    def labels(text):
        return {d[0] for d in scanner.scan(text)[2]}

    assert labels("released under the Simplified BSD License") == {"bsd-2-clause"}
    assert labels("FreeBSD License") == {"bsd-2-clause"}
    assert labels("the New BSD License, the Revised BSD, the Modified BSD") == {"bsd-3-clause"}
    assert labels("Original BSD license") == {"bsd-4-clause"}
    assert labels("Expat license") == {"mit"}
    assert labels("SPDX-License-Identifier: MIT-0") == {"mit-0"}
    assert labels("SPDX-License-Identifier: MIT") == {"mit"}
    assert labels("GPL2 or CeCILL2.1") == {"gpl-abbreviation-2", "cecill-2.1"}


def test_quality_counts_equal_brute_force(docs, odd_texts):
    got = {r.doc_id: r for r in quality_rules.judge(docs(odd_texts)).collect()}
    for i, text in enumerate(odd_texts):
        text = text or ""
        words = WORD.findall(text)
        windows = {}
        for k in range(len(words) - 7):
            windows.setdefault(tuple(words[k : k + 8]), []).append(k)
        covered = {p for at in windows.values() if len(at) > 1 for k in at for p in range(k, k + 8)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
        assert r.base_failed == failed and not (failed and r.kept)
    assert quality_rules.judge(docs([])).count() == 0


def test_quality_has_no_exchange_and_no_python(docs):
    plan = quality_rules.judge(docs(["a b"]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_quality_sql_twin(spark, sf_dir):
    con = connect(sf_dir)
    name = "op4_quality_rules"
    assert compare(spark, con, QUERIES[name], ORACLES[name], sf_dir) == ""


def test_language_held_out_accuracy(spark, sf_dir):
    truth = {i: lang for i, lang in duckdb.sql(f"select doc_id, lang from read_parquet('{sf_dir}/documents.parquet')").fetchall()}
    rows = QUERIES["op9_lang_conv"](spark, sf_dir).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out and truth[r.doc_id]]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.9 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edges(docs, odd_texts):
    df = docs(odd_texts)
    assert lang_conv.train(df.limit(0)) is None
    got = {r.doc_id: r for r in lang_conv.predict(df, lang_conv.train(df)).collect()}
    for i, text in enumerate(odd_texts):
        letters = text is not None and any(c.isalpha() for c in text)
        assert (got[i].lang_pred, got[i].score) == (("en", 1.0) if letters else ("und", 0.0))
    assert {r.lang_pred for r in lang_conv.predict(df, None).collect()} == {"und"}
    kept = lang_conv.identified(df, lang_conv.train(df))
    assert kept.columns == df.columns
    # The sample is bounded, and the same in each run.
    many = docs([f"word{i} and more" for i in range(300)])
    sample = lang_conv.training_sample(many, per_lang=20, windows=2)
    assert len(sample) <= 2 * 20 * 2 and sample == lang_conv.training_sample(many.repartition(5), per_lang=20, windows=2)


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><a href=x>Menu</a></nav><div class="cookie-notice">Cookies</div>
<div id="c"><article class="post-%d"><h1>Title &amp; %d</h1><p>One<br>two&nbsp;three<p>Four <b>five<p>Six
<script>var x="</p>"</script><div class="share">tweet</div><form>mail</form></article>
<section class="comments"><p>nice</p></section></div><footer>f &copy;</footer></body></html>"""


@pytest.fixture(scope="module")
def pages(spark, docs):
    def make(rows):
        return spark.createDataFrame(rows, "page_id long, url string, html string, text string, host string, paths string")

    return make


def test_extraction_by_host(pages):
    odd = [None, "", "plain  text", "<p>a<p>b", "<!-- open", '<a href="x>y</a>z', "<p " * 5000, "&#x110000; a < b"]
    rows = [(i, "http://h.example/%d" % i, PAGE % (i, i), "x", "x", "x") for i in range(5)]
    rows += [(100 + i, None if i % 2 else "not a url", h, "x", "x", "x") for i, h in enumerate(odd)]
    rows.append(rows[0])
    got = host_paths.extract(pages(rows)).collect()
    assert len(got) == len(rows)
    text = {r.page_id: r.text for r in got}
    for i in range(5):
        assert text[i] == f"Title & {i}\n\nOne two three\n\nFour five\n\nSix"
    assert text[100] == "" and text[101] == "" and text[102] == "plain text" and text[103] == "a\n\nb"
    assert all(r.n_chars == len(r.text) for r in got)
    assert {r.path for r in got if r.page_id < 5} == {"/html/body.has-sidebar/div/article.post-#"}
    assert host_paths.extract(pages(rows).limit(0)).count() == 0


def test_page_without_the_hosts_path_uses_its_own(pages):
    rows = [(i, "http://h.example/", f"<html><body><article><p>text {i} is here</article>", "", "", "") for i in range(60)]
    rows.append((99, "http://h.example/", "<html><body><div class=story><p>other text</div>", "", "", ""))
    got = {r.page_id: r for r in host_paths.extract(pages(rows)).collect()}
    assert got[5].text == "text 5 is here" and got[99].text == "other text"


def test_extraction_leaves_no_part_of_an_article_out(pages):
    body, more = "long text of the story " * 40, "the last part of it " * 9
    parted = f"<article><div class=title><h1>Head</h1></div><div class=text><p>{body}</p></div><div class=more><p>{more}</p></div></article>"
    menu = "<div class=list><a href=1>one link</a> <a href=2>another link</a></div>"
    named = f"<article><div class=article-header><h1>Head</h1></div><p>{body}</p></article>"
    # The host's usual path has a line of text on a page of another template.
    other = f"<article><p>short teaser</p></article><div class=story><h2>Story</h2><p>{body}</p></div>"
    beside = f"<div class=top><h1>Head</h1></div><article><p>{body}</p></article>"
    two = f"<article><p>{body}</p></article><article><p>{more}</p></article>"
    rows = [(i, "http://h.example/", f"<html><body>{menu}<article><p>{body} {i}</p></article>", "", "", "") for i in range(40)]
    cases = [parted, menu + parted, named, other, beside, two]
    rows += [(100 + i, "http://h.example/", f"<html><body>{h}", "", "", "") for i, h in enumerate(cases)]
    got = {r.page_id: r.text for r in host_paths.extract(pages(rows)).collect()}
    body, more = body.strip(), more.strip()
    assert got[7] == f"{body} 7"
    assert got[100] == got[101] == f"Head\n\n{body}\n\n{more}"
    assert got[102] == f"Head\n\n{body}"
    assert got[103] == f"short teaser\n\nStory\n\n{body}"
    assert got[104] == f"Head\n\n{body}"
    assert got[105] == f"{body}\n\n{more}"


BODY = ("long text of the story " * 5).strip()
WHOLE_ARTICLES = [
    # Names of wrappers say nothing of the article in them.
    (f'<div class="layout-with-sidebar"><article><p>{BODY}</p></article><div class="sidebar-left">x y z</div></div>', [BODY]),
    (f'<div id="page" class="site has-sidebar"><main><p>{BODY}</p></main></div>', [BODY]),
    (f'<div class="overflow-hidden"><article><p>{BODY}</p></article></div>', [BODY]),
    (f'<article><p>{BODY}</p><div id="social-history"><p>one</p></div><p class="search-result">two</p></article>', [BODY, "one", "two"]),
    (f"<form id=aspnetForm><div class=c><h1>T</h1><p>{BODY}</p></div></form>", ["T", BODY]),
    # Words in other attributes.
    ('<article><p>see <a href="/the-hidden-truth">the story</a></p><p title="a hidden gem">gem</p></article>', ["see the story", "gem"]),
    ("<article><p data-hidden=1>a</p><p data-x='style=display:none'>b</p></article>", ["a", "b"]),
    # Raw elements without an end.
    ('<article><p>a</p><svg class="i"/><p>b</p></article>', ["a", "b"]),
    ('<article><p>a</p><svg class="i"><p>lost in it</p></article><article><p>c</p></article>', ["a", "c"]),
    # Headings and links at any depth, all of an article's header, formulas.
    (f"<article><header><h1><a><span><b><i>Deep title</i></b></span></a></h1><p>lead</p></header><p>{BODY}</p></article>", ["Deep title", "lead", BODY]),
    ("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be</p></article>", ["Let x=1 be"]),
    # References at the end of an article are mostly links.
    (f"<article><div><p>{BODY}</p></div><p><a href=1>reference one</a> <a href=2>two</a></p></article>", [BODY, "reference one two"]),
    # Noise that is longer than the article.
    (f"<article><h1>T</h1><p>short</p></article><div class=ad>{BODY}</div><div id=comments><article>{BODY} {BODY}</article></div>", ["T", "short"]),
    (f'<div class=post><h1>T</h1><p>short</p></div><ol class="comment-list"><li>{BODY}</li></ol>', ["T", "short"]),
    (f"<article><p>{BODY}</p><div class=social-share>tell others</div><div class=newsletter>get more</div></article>", [BODY]),
]


def test_extraction_gives_whole_articles(pages):
    rows = [(i, f"http://h{i}.example/", f"<html><body>{h}", "", "", "") for i, (h, _) in enumerate(WHOLE_ARTICLES)]
    got = {r.page_id: r.text for r in host_paths.extract(pages(rows)).collect()}
    for i, (source, want) in enumerate(WHOLE_ARTICLES):
        assert got[i] == "\n\n".join(want), source


def test_votes_are_counted_by_host(pages):
    rows = [(i, f"http://h{i % 2}.example/{i}", f"<body><div class=c{i}><p>{'x' * (i + 1)}</p></div>", "", "", "") for i in range(9)]
    rows.append((10, None, "<body><p>abc</p>", "", "", ""))
    want = {}
    for i in range(9):
        key = (f"h{i % 2}.example", "/body/div.c#")
        want[key] = want.get(key, 0) + i + 1
    want["", "/body"] = 3
    got = {}
    for r in host_paths.votes(pages(rows)).collect():
        got[r.host, r.path] = got.get((r.host, r.path), 0) + r.weight
    assert got == want


def test_extraction_of_given_pages(spark, sf_dir):
    source = dict(duckdb.sql(f"select page_id, html from read_parquet('{sf_dir}/pages.parquet')").fetchall())
    for r in QUERIES["op3_host_paths"](spark, sf_dir).collect():
        article = re.search(r"<article>(.*?)</article>", source[r.page_id], re.S)[1]
        blocks = re.split(r"</?[a-z0-9]+>", re.sub(r"</?b>", "", article).replace("<br>", " "))
        blocks = [" ".join(references.unescape(b).split()) for b in blocks]
        assert r.text == "\n\n".join(b for b in blocks if b)
