"""Operators whose rows meet: mixing, line dedup, sketches, SimHash, language model, pipeline."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from geopulse.llm import block_mix, interpolated_lm, line_dedup, near_copies, scaled_sketch, simhash_trees
from geopulse.llm.components import components
from geopulse.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def given(sf_dir):
    return pd.read_parquet(f"{sf_dir}/documents.parquet")


# --- mixing ----------------------------------------------------------------------------------
def filled(sizes, weights, most=3):
    """Targets by resharing step by step."""
    total, capped = sum(sizes), set()
    while True:
        left = total - sum(most * sizes[i] for i in capped)
        share = sum(w for i, w in enumerate(weights) if i not in capped)
        target = [most * s if i in capped else left * w / share for i, (s, w) in enumerate(zip(sizes, weights))]
        over = {i for i, t in enumerate(target) if t > most * sizes[i] + 1e-9} - capped
        if not over:
            return target
        capped |= over


def test_mix_hits_targets(docs, odd_texts):
    random.seed(4)
    rows = []
    for i in range(400):
        source = random.choice(["big"] * 6 + ["mid", "tiny", "zeta", None])
        text = " ".join("w%d" % random.randint(0, 99) for _ in range(3 if source == "tiny" else random.randint(0, 700)))
        rows.append((i, text, "en", source, 0, "x", "x", "x", "x", "x", "x"))
    rows += [(1000 + i, t, "en", "odd", 0, "x", "x", "x", "x", "x", "x") for i, t in enumerate(odd_texts[:7])]
    rows.append((2000, "", "en", "empty", 0, "x", "x", "x", "x", "x", "x"))
    rows.append(rows[3])
    got = block_mix.mix(docs(None, rows)).collect()
    assert len(got) == len(rows)
    source = {r[0]: r[3] for r in rows}
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        assert r.size == len(WORD.findall(next(x[1] for x in rows if x[0] == r.doc_id) or ""))
        assert 0 <= r.taken <= 3 * r.size
        size[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    names = sorted([n for n in size if n is not None]) + [None]
    want = filled([size[n] for n in names], [1 + i % 3 for i in range(len(names))])
    for name, t in zip(names, want):
        assert target[name] == pytest.approx(t)
        assert abs(taken[name] - t) <= 1
    again = block_mix.mix(docs(None, rows).repartition(7)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))
    assert block_mix.mix(docs([])).count() == 0
    assert {r.taken for r in block_mix.mix(docs([None, "", " "])).collect()} == {0}


def test_permutation_is_one_and_inverts(spark):
    for n in (1, 2, 7, 100, 257):
        df = spark.range(n).select("id", F.lit(n).cast("long").alias("n"))
        to = block_mix.permuted(F.col("id"), F.col("n"), F.lit(5), F.lit("s"))
        back = block_mix.permuted(F.col("to"), F.col("n"), F.lit(5), F.lit("s"), inverse=True)
        rows = df.withColumn("to", to).withColumn("back", back).collect()
        assert sorted(r.to for r in rows) == list(range(n)) and all(r.back == r.id for r in rows)


def test_mixed_documents_are_their_words(docs):
    rows = [(i, " ".join(f"d{i}w{k}" for k in range(40 + i)), "en", "ab"[i % 2], 0, *"xxxxxx") for i in range(60)]
    df = docs(None, rows)
    taken = {r.doc_id: r.taken for r in block_mix.mix(df).collect()}
    out = block_mix.mixed_documents(df)
    assert out.columns == df.columns
    seen = Counter()
    for r in out.collect():
        words = r.text.split()
        assert set(words) <= set(rows[r.doc_id][1].split()) and words == sorted(words, key=lambda w: int(w.split("w")[1]))
        seen[r.doc_id] += len(words)
    assert {k: v for k, v in taken.items() if v} == dict(seen)


# --- line dedup ------------------------------------------------------------------------------
def brute_lines(rows):
    """Line numbers to remove, by comparing each line with all earlier ones that share a word."""
    seen, by_word, out = [], defaultdict(set), defaultdict(list)
    for key, text in rows:
        for n, line in enumerate((text or "").lower().split("\n")):
            words = frozenset(WORD.findall(line))
            if not words:
                continue
            near = Counter(j for w in words for j in by_word[w])
            if any(9 * o >= 4 * (len(words) + len(seen[j])) for j, o in near.items()):
                out[key].append(n)
            for w in words:
                by_word[w].add(len(seen))
            seen.append(words)
    return out


def test_lines_equal_brute_force(docs):
    random.seed(6)
    vocabulary = [f"w{int(random.paretovariate(0.6)) % 400}" for _ in range(400)]
    base = [[random.choice(vocabulary) for _ in range(random.choice([1, 2, 3, 4, 5, 9, 20, 60]))] for _ in range(60)]
    texts = [None, "", "\n \n"]
    for _ in range(150):
        lines = []
        for _ in range(random.randint(1, 6)):
            line = list(random.choice(base)) if random.random() < 0.7 else [random.choice(vocabulary) for _ in range(15)]
            for _ in range(random.randint(0, 4)):
                line[random.randrange(len(line))] = random.choice(vocabulary)
            random.shuffle(line)
            lines.append(" ".join(line).title())
        texts.append("\n".join(lines))
    df = docs(texts)
    want = brute_lines(enumerate(texts))
    got = {r.doc_id: r for r in line_dedup.report(df).collect()}
    assert len(got) == len(texts)
    assert {k: r.removed for k, r in got.items() if r.removed} == dict(want)
    assert all(got[i].n_lines == (0 if t is None else t.count("\n") + 1) for i, t in enumerate(texts))
    left = line_dedup.without_lines(df)
    assert left.columns == df.columns
    kept = {r.doc_id: r for r in left.collect()}
    for i, text in enumerate(texts):
        lines = [x for n, x in enumerate((text or "").split("\n")) if n not in want.get(i, [])]
        if i in want and not WORD.search("\n".join(lines)):
            assert i not in kept
        elif text is not None:
            assert kept[i].text == "\n".join(lines) and kept[i].n_chars == len(kept[i].text)
    assert kept[0].text is None
    assert line_dedup.report(docs([])).count() == 0


def test_large_near_copy_groups_of_lines(docs):
    random.seed(7)
    base = [f"word{i}" for i in range(40)]
    texts = []
    for i in range(300):
        line = list(base)
        for k in random.sample(range(40), random.randint(0, 3)):
            line[k] = f"new{i}x{k}"
        texts.append(" ".join(line))
    got = {r.doc_id: r.removed for r in line_dedup.report(docs(texts)).collect() if r.removed}
    assert got == dict(brute_lines(enumerate(texts)))


def test_constants_of_lines_are_short(docs):
    """A constant stands in every plan that names it; 20 digits for each counter took much of the driver's memory."""
    levels = line_dedup.rarity(docs(["the cat sat", "the dog", None]))
    assert len(str(levels)) < 4 * line_dedup.BUCKETS
    df = docs([f"text {i}" for i in range(50)])
    rows = line_dedup.bit_filter(df.where("doc_id < 20"), "doc_id")
    passing = {r.doc_id for r in rows(df, F.col("doc_id")).collect()}
    others = {r.doc_id for r in rows(df, F.col("doc_id"), passing=False).collect()}
    assert set(range(20)) <= passing and not passing & others and passing | others == set(range(50))


def test_postings_carry_what_filters_need(docs):
    """Places are asked of the pairs that are left; postings with them took half as much again."""
    df = docs(["a b c d e f g h", "a b c d e f g h i", "x y"])
    sets = line_dedup.line_sets(df, line_dedup.rarity(df)).withColumn("done", F.lit(False))
    plan = line_dedup.pairs_by_prefix(sets)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    at = [i for i, line in enumerate(plan) if "Generate posexplode(prefix" in line]
    posted = [next(line for line in reversed(plan[:i]) if "Project [" in line) for i in at]
    assert posted and all("token" in line and "doc_id" not in line for line in posted)


def test_texts_of_kept_documents_are_shuffled_once(docs, spark):
    """Of rows that repeat key and text, null or not, one stays; the join and dropping repeats share their partitions."""
    rows = [(k, t, "en", "s", 1, *"xxxxxx") for k, t in [(1, "a b c"), (1, "a b c"), (None, "d e f"), (None, "d e f"), (2, None), (3, "")]]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = near_copies.one_of_each(docs(None, rows))
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2
        got = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == [(1, "a b c"), (2, None), (None, "d e f")]


def test_parity_vectors_follow_the_size():
    random.seed(9)
    for n, words in ((0, 1), (1, 1), (64, 1), (65, 2), (500, 8), (5000, 32)):
        h = np.array(random.sample(range(1 << 62), n), np.uint64)
        vector = near_copies.parity(h)
        assert len(vector) == words
        # A vector of half the bits is its two halves xor-ed.
        if words > 1:
            half = np.bincount((h >> np.uint64(20) & np.uint64(32 * words - 1)).astype(np.int64), minlength=32 * words) & 1
            halves = np.unpackbits(vector.view(np.uint8)).reshape(2, -1)
            assert (halves[0] ^ halves[1] == half).all()


# --- sketches --------------------------------------------------------------------------------
def test_sketches_of_edited_texts(docs, odd_texts):
    texts = odd_texts + ["tail words here and there " * 20]
    got = {r.doc_id: r for r in scaled_sketch.compare_edited(docs(texts)).collect()}
    plain = {r.doc_id: r.fingerprint for r in scaled_sketch.fingerprints(docs(texts)).collect()}
    tool = scaled_sketch.Sketcher()
    for i, text in enumerate(texts):
        text, following = text or "", texts[(i + 1) % len(texts)] or ""
        changed = scaled_sketch.edited(text, following)
        r = got[i]
        assert r.n_chars == len(text) and r.fingerprint == plain[i]
        assert r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        a, b = tool.sketch(text.encode()), tool.sketch(changed.encode())
        assert r.edited_fingerprint == scaled_sketch.fingerprint(b)
        assert r.near_edited == scaled_sketch.likeness(a, b)
        assert r.near_next == scaled_sketch.likeness(a, tool.sketch(following.encode()))
        assert scaled_sketch.fingerprint(scaled_sketch.parse(r.fingerprint)) == r.fingerprint
    assert got[4].fingerprint == got[5].fingerprint and got[4].near_next == 1.0
    assert scaled_sketch.compare_edited(docs([])).count() == 0
    one = scaled_sketch.compare_edited(docs(["just one text here today"])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_sketch_order_with_gaps_ties_and_nulls(docs):
    keys = [50, None, 7, 7, 900, -3]
    rows = [(k, f"text number {i} " * 5, "en", "s", 0, *"xxxxxx") for i, k in enumerate(keys)]
    got = scaled_sketch.compare_edited(docs(None, rows)).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = {}
    for a, b in zip(order, order[1:] + order[:1]):
        want[(a[0], hashlib.sha256(scaled_sketch.edited(a[1], b[1]).encode()).hexdigest())] = 1
    assert {(r.doc_id, r.edited_sha256) for r in got} == set(want)


def test_sketch_estimates_and_merges():
    random.seed(8)
    tool = scaled_sketch.Sketcher()
    words = [f"w{random.randint(0, 5000)}" for _ in range(40_000)]
    part, whole = " ".join(words[:4000]).encode(), " ".join(words).encode()
    a, b = tool.sketch(part), tool.sketch(whole)
    assert scaled_sketch.containment(a, b) == 1.0
    assert abs(scaled_sketch.containment(b, a) - 0.1) < 0.03
    rest = tool.sketch(" ".join(words[3996:]).encode())
    merged = scaled_sketch.merge(a, rest)
    assert merged[0] == b[0] and (merged[1] == b[1]).all()


def test_sketch_estimates_equal_jaccard_of_whole_documents(docs):
    random.seed(13)
    texts = [" ".join(f"w{random.randint(0, 3000)}" for _ in range(n)) for n in [*range(10, 40), *range(40, 301, 10)] for _ in range(2)]
    # The second of two is a near copy of the first.
    for i in range(0, len(texts), 2):
        words = texts[i].split()
        words[len(words) // 2] = "other"
        texts[i + 1] = " ".join(words)

    def shingles(text):
        words = WORD.findall(text)
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}

    got = {r.doc_id: r for r in scaled_sketch.compare_edited(docs(texts)).collect()}
    for i, text in enumerate(texts):
        following = texts[(i + 1) % len(texts)]
        a, b, c = shingles(text), shingles(scaled_sketch.edited(text, following)), shingles(following)
        assert got[i].near_edited == pytest.approx(len(a & b) / len(a | b))
        assert got[i].near_next == pytest.approx(len(a & c) / len(a | c))
        assert got[i].contained_in_next == pytest.approx(len(a & c) / len(a))


# --- SimHash ---------------------------------------------------------------------------------
def slow_fingerprint(text):
    words = WORD.findall((text or "").translate(LOW))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps, radius=4):
    label = list(range(len(fps)))
    for _ in fps:
        before = list(label)
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= radius:
                    label[i] = label[j] = min(label[i], label[j])
        if before == label:
            return label


def test_simhash_equals_brute_force(docs, odd_texts):
    random.seed(9)
    base = [f"w{random.randint(0, 900)}" for _ in range(300)]
    texts = list(odd_texts)
    for i in range(60):
        line = list(base)
        for _ in range(i % 6):
            line[random.randrange(300)] = f"n{random.randint(0, 99)}"
        texts.append(" ".join(line).title())
    fps = [slow_fingerprint(t) for t in texts]
    got = {r.doc_id: r for r in simhash_trees.near_duplicates(docs(texts)).collect()}
    assert [got[i].fp & (2**64 - 1) for i in range(len(texts))] == fps
    assert [got[i].component_id for i in range(len(texts))] == slow_components(fps)
    # Small shards, so that groups are dealt to several trees.
    small = {r.doc_id: r.component_id for r in simhash_trees.near_duplicates(docs(texts), shard=5).collect()}
    assert small == {i: r.component_id for i, r in got.items()}
    assert simhash_trees.near_duplicates(docs([])).count() == 0


def test_trees_find_all_near_pairs():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 40, dtype=np.int64).view(np.uint64)
    fp = np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(6)])
    fp = np.unique(fp)
    group = np.sort(rng.integers(0, 3, len(fp)))
    forest = simhash_trees.Forest(group, fp, 2)
    found = {(int(q), int(n)) for qs, ns in forest.near(group, fp) for q, n in zip(qs, ns)}
    want = {(i, j) for i in range(len(fp)) for j in range(len(fp)) if group[i] == group[j] and int(fp[i] ^ fp[j]).bit_count() <= 2}
    assert found == want


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (500, 499)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    want = {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 60)} | {500: 499}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- near copies -----------------------------------------------------------------------------
def test_near_copies_equal_brute_force(docs, odd_texts):
    import corpus_pipeline

    random.seed(12)
    texts = list(odd_texts)
    for n in (5, 8, 9, 12, 30, 100, 300):
        for g in range(4):
            base = [f"b{n}x{random.randint(0, 4000)}" for _ in range(n)]
            for i in range(8):
                line = list(base)
                for _ in range(random.randint(0, max(1, n // 25))):
                    line[random.randrange(n)] = f"n{random.randint(0, 9999)}"
                if i == 3:
                    line.append("tail")
                texts.append(" ".join(line).title())
    sets = []
    for t in texts:
        words = WORD.findall((t or "").translate(LOW))
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    label = list(range(len(texts)))
    edges = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] == sets[j] or 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])) > 0]
    for _ in texts:
        for i, j in edges:
            label[i] = label[j] = min(label[i], label[j])
    far = [1 for i, j in edges if (slow_fingerprint(texts[i]) ^ slow_fingerprint(texts[j])).bit_count() > 4]
    assert len(far) > 20
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(docs(texts)).collect()}
    assert got == dict(enumerate(label))
    kept = corpus_pipeline.near_duplicates(docs(texts).sparkSession, docs(texts), None)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(label))
    assert near_copies.one_of_each(docs([])).count() == 0


def test_one_of_each_goes_by_row_and_not_by_key(spark):
    a, near_a = "one text of more than five words that comes often " * 9, "one text of more than five words that comes often " * 9 + "end"
    b, c = "another text that nothing else is like, with words of its own", "a third one that is like no other text of the table"
    rows = [(1, a), (5, a), (5, b), (5, b), (None, c), (None, near_a), (None, None), (7, ""), (9, near_a)]
    schema = "doc_id long, text string, stay_key string, `__key` string, text_hash string"
    df = spark.createDataFrame([(k, t, "x", "x", "x") for k, t in rows], schema)
    kept = near_copies.one_of_each(df)
    assert kept.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    assert got == sorted([(1, a), (5, b), (None, c), (7, "")], key=repr)


def long_texts():
    """Unlike each other but for a passage; the last but one is like the last."""
    random.seed(14)
    passage = " ".join(f"p{i}" for i in range(300))
    texts = [f"{passage} " + " ".join(f"w{k}x{i}" for i in range(random.randint(6000, 6900))) for k in range(6)]
    return [*texts, texts[-1] + " end of it"]


# of sets of some 4,600 shingles or more all pairs that met passed the parity vectors of 2,048 bits and were compared as a whole.
def test_large_sets_that_meet_go_by_their_parity_vectors(docs):
    df = docs(long_texts())
    seen = near_copies.described(df, "doc_id", "text").where("part IS NULL")
    cls = {r.doc_id: r.cls for r in seen.collect()}
    assert len(set(cls.values())) == 7
    pairs = df.sparkSession.createDataFrame([(cls[i], cls[j]) for i in cls for j in cls if j < i], "a long, b long")
    assert [tuple(r) for r in near_copies.may_be_similar(seen, pairs).collect()] == [(cls[6], cls[5])]


# one shingle in common was enough for a pair, however large its sets.
def test_pairs_meet_at_enough_shingles_for_their_sizes(docs):
    df = docs(long_texts())
    seen = near_copies.described(df, "doc_id", "text")
    cls = {r.doc_id: r.cls for r in seen.where("part IS NULL").collect()}
    # All shingles count as equally rare, so the passage is among the first ones.
    met = near_copies.meetings(df, np.zeros(near_copies.BUCKETS, np.uint8), "doc_id", "text")
    assert met.select("cls").distinct().count() == 7
    none = df.sparkSession.createDataFrame([], "node long, root long")
    apart, used = near_copies.pairs_apart(met, none)
    assert [{r.a, r.b} for r in apart.collect()] == [{cls[5], cls[6]}]
    near_copies.free(*used)


def test_enough_shingles_in_common_never_leave_out_a_similar_pair(spark):
    random.seed(15)
    rows = []
    for _ in range(3000):
        n = random.randint(4, 60)
        base = random.sample(range(10_000), n)
        other = {*base[: n - random.randint(0, n // 4)], *random.sample(range(10_000), random.randint(0, n // 4))}
        a, b = sorted(base), sorted(other)
        heads = [set(x[: len(x) - (4 * len(x) + 4) // 5 + 1]) for x in (a, b)]
        common = len(set(a) & set(b))
        rows.append((len(a), len(b), len(heads[0] & heads[1]), 9 * common >= 4 * (len(a) + len(b))))
    df = spark.createDataFrame(rows, "na int, nb int, common int, similar boolean")
    passed = df.where(near_copies.may_have_enough() & (F.col("common") > 0))
    assert passed.where("similar").count() == df.where("similar").count() > 500
    assert passed.count() < df.count()


def folder_sizes(spark):
    from geopulse.session import shared_dir

    return {n for n in os.listdir(shared_dir(spark)) if n.startswith(("near-", "line-", "links-", "removed-", "hot-"))}


def test_scratch_tables_are_freed(docs, spark, odd_texts):
    before = folder_sizes(spark)
    texts = [*odd_texts, *[f"line {i} of a text that has many words\nand a second line of it {i % 3}" for i in range(40)]]
    near_copies.one_of_each(docs(texts)).count()
    line_dedup.without_lines(docs(texts)).count()
    # What results are read from stays, no intermediate table does.
    assert len(folder_sizes(spark) - before) <= 6


# --- language model --------------------------------------------------------------------------
def test_language_model_counts_equal_brute_force(docs, odd_texts):
    texts = odd_texts + ["the cat sat on the mat"] * 3 + ["a cat sat on a mat"]
    tokens = {i: WORD.findall((t or "").translate(LOW)) + ["<end>"] for i, t in enumerate(texts)}
    count = Counter()
    for i, words in tokens.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            count.update(words)
    n, v = sum(count.values()), len(count)
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1
    got = interpolated_lm.score(docs(texts), learn).collect()
    assert len(got) == len(texts)
    for r in got:
        words = tokens[r.doc_id]
        base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(count[w] > 0 for w in words), n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0
    none = interpolated_lm.score(docs(["a b", None]), F.lit(False)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in none)
    assert interpolated_lm.score(docs([]), F.lit(True)).count() == 0


def test_language_model_beats_the_base_on_held_out(spark, sf_dir, given):
    rows = [r for r in QUERIES["op10_interpolated_lm"](spark, sf_dir).collect()]
    assert len(rows) == len(given)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_model_is_a_distribution():
    """With learned weights, the probabilities of all words after a context sum to one."""
    cells = [((3 * 512 + 9) * 512 + 40, 50), ((3 * 512 + 0) * 512 + 60, 20), ((0 * 512 + 0) * 512 + 60, 5)]
    weights = interpolated_lm.learn_weights(cells, 0.001)
    assert np.allclose(weights.sum(axis=1), 1) and (weights[:, 1:] > 0).all() and weights[0, 0] == 0
    assert weights[3, 0] > weights[3, 2]


# --- pipeline --------------------------------------------------------------------------------
def test_pipeline_stages(spark, sf_dir, given):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, ids, out = docs.columns, set(given.doc_id), None
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        now = out.select("doc_id").distinct().toPandas().doc_id
        assert set(now) <= ids
        ids = set(now)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
            path = f"{spark.sparkContext.getCheckpointDir()}/stage{i}"
            out.write.mode("overwrite").parquet(path)
            docs = spark.read.parquet(path)
    assert out.count() == docs.count()
