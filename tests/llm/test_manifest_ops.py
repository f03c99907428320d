"""Token alignment, token files and the Merkle manifest against brute force."""

import base64
import glob
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow.orc as orc
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from geopulse.llm import merkle, token_alignment, token_store
from geopulse.llm.queries import QUERIES
from geopulse.session import scratch_path

PARTS = [
    "a", "the", " ", "  ", "   ", "\n", "\n\n", "\t", "\r", ";\r", " {\r\n", "é", "日本", "😀", "́", "1", "²", "'s", "n't", "=", "__",
    "​", "\x85", "\x1c", "\xa0", " ", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x0A>", "\x00", "ß", "!!", "-", "x" * 60, "Wort", "İ",
]


def random_texts(n, seed=1):
    random.seed(seed)
    return ["".join(random.choice(PARTS) * random.choice([1, 1, 2, 5]) for _ in range(random.randint(0, 25))) for _ in range(n)]


# --- 11 ------------------------------------------------------------------------------------------


class Plain:
    """Whole texts by the libraries themselves, all token pairs compared."""

    def __init__(self):
        a, b = token_alignment.vocabularies()
        self.a, self.b = Tokenizer.from_file(a), SentencePieceProcessor(model_file=b)
        self.a.encode_special_tokens = True
        table = {}
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [x for x in range(256) if x not in printable]
        table = {chr(x): x for x in printable} | {chr(256 + i): x for i, x in enumerate(others)}
        self.table = table

    def bytes_a(self, i):
        return bytes(self.table[c] for c in self.a.id_to_token(i))

    def bytes_b(self, i):
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def tokens(self, text):
        """Tokens as (id, start, end) of both, or two empty lists."""
        raw = (" " + (text or "")).encode()
        ids = self.a.encode(" " + (text or ""), add_special_tokens=False).ids, self.b.encode(text or "")
        if not text:
            return [], []
        out = []
        for tokens, spell in zip(ids, (self.bytes_a, self.bytes_b)):
            at, row = 0, []
            for i in tokens:
                size = len(spell(i))
                row.append((i, at, at + size))
                at += size
            if b"".join(map(spell, tokens)) != raw:
                return [], []
            out.append(row)
        return out

    def groups(self, a, b):
        ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
        out, low = [], 0
        for e in ends:
            out.append(([i for i, s, x in a if low <= s and x <= e], [i for i, s, x in b if low <= s and x <= e]))
            low = e
        return out

    def report(self, texts):
        rows = [self.tokens(t) for t in texts]
        links = [[(i, j) for i, s, e in a for j, u, v in b if s < v and u < e] for a, b in rows]
        counts = Counter(x for row in links for x in row)
        best = {}
        for (_, j), n in counts.items():
            best[j] = max(n, best.get(j, 0))
        out = []
        for (a, b), row in zip(rows, links):
            groups = self.groups(a, b)
            text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
            digest = hashlib.sha256(text.encode()).hexdigest() if a else ""
            n_best = sum(counts[x] == best[x[1]] for x in row)
            out.append((len(a), len(b), len(groups), len(row), n_best, sum(counts[x] for x in row), digest))
        return out


NAMES = [*token_alignment.FIELDS, "groups_sha256"]


def check_report(df, texts):
    want = Plain().report(texts)
    got = {r.doc_id: tuple(r[n] for n in NAMES) for r in token_alignment.report(df, *token_alignment.vocabularies()).collect()}
    assert len(got) == len(texts)
    for i, row in enumerate(want):
        assert got[i] == row, texts[i]


def test_alignment_equals_all_pairs(docs, odd_texts):
    # The long text is compared in the next test.
    texts = [t for t in odd_texts if t is None or len(t) < 5000] + ["▁", "a▁b c", "it's a\n test\n", " lead", "tail "] + random_texts(300)
    check_report(docs(texts).repartition(5), texts)


def test_alignment_of_small_batches_and_long_texts(docs, odd_texts, monkeypatch):
    monkeypatch.setattr(token_alignment, "BATCH", 3)
    monkeypatch.setattr(token_alignment, "CACHED_UNIT", 2)
    texts = random_texts(40, 2)
    check_report(docs(texts), texts)
    long = max((t for t in odd_texts if t), key=len)
    row = token_alignment.report(docs([long]), *token_alignment.vocabularies()).first()
    a, b = Plain().tokens(long)
    assert (row.n_a, row.n_b) == (len(a), len(b)) and row.n_groups == len({e for *_, e in a} & {e for *_, e in b})


def test_units_are_whole_and_tokenize_alone():
    tool, plain = token_alignment.Aligner(*token_alignment.vocabularies()), Plain()
    for text in random_texts(3000, 5):
        units = token_alignment.units_of(text)
        assert "".join(units) == (" " + text if text else "")
        assert units == token_alignment.UNIT.findall(" " + text if text else "")
        if not text or "▁" in text:
            continue
        got = tool.tokenized(units)
        assert all(got)
        a, b = (np.frombuffer(b"".join(x), "<u4").tolist() for x in zip(*got))
        assert a == plain.a.encode(" " + text, add_special_tokens=False).ids
        assert b == plain.b.encode(text)


def test_galloping_equals_sets():
    random.seed(4)
    for _ in range(2000):
        a = sorted(random.sample(range(300), random.randint(0, 40))) + [300]
        b = sorted(random.sample(range(300), random.randint(0, 200))) + [300]
        both = sorted(set(a) & set(b))
        known = sorted(random.sample(both, random.randint(0, len(both))))
        spots = [np.array([x.index(k) for k in known], np.int64) for x in (a, b)]
        i, j = token_alignment.common_ends(np.array(a), np.array(b), *spots)
        assert [a[x] for x in i] == [b[x] for x in j] == both


def test_alignment_groups_cover_the_text(docs, odd_texts):
    found = token_alignment.groups(docs(odd_texts), *token_alignment.vocabularies()).collect()
    plain = Plain()
    for r in found:
        text = odd_texts[r.doc_id]
        if not text:
            assert r.groups == []
            continue
        assert [g.start for g in r.groups] == [0, *[g.end for g in r.groups[:-1]]]
        raw = (" " + text).encode()
        for g in r.groups[:200]:
            assert b"".join(map(plain.bytes_a, g.a)) == raw[g.start : g.end] == b"".join(map(plain.bytes_b, g.b))


def test_alignment_of_odd_tables(docs):
    paths = token_alignment.vocabularies()
    assert token_alignment.report(docs([]), *paths).count() == 0
    rows = [(None, "a b", "en", "s", 3, *["x"] * 6), (7, "a b", "en", "s", 3, *["x"] * 6), (7, "a b", "en", "s", 3, *["x"] * 6)]
    got = token_alignment.report(docs(None, rows), *paths).collect()
    assert [r.doc_id for r in got].count(7) == 2 and [r.doc_id for r in got].count(None) == 1
    assert len({r.count_sum for r in got}) == 1 and got[0].count_sum == 3 * got[0].n_links


# --- 12 ------------------------------------------------------------------------------------------


def plain_store(rows):
    """Rows (key, text) in order of the key, ties by the others' order in any way: key, tokens, crc."""
    library = Tokenizer.from_file(token_store.vocabulary())
    out = []
    for key, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [token_store.END_ID]
        out.append((key, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    return out


def test_tokens_equal_the_library(docs, odd_texts):
    texts = odd_texts + random_texts(1500, 6)
    found = token_store.written_and_read(docs(texts).repartition(7), token_store.vocabulary()).collect()
    at = 0
    for row, (key, size, crc) in zip(sorted(found), plain_store(enumerate(texts)), strict=True):
        assert row == (key, at, size, crc), texts[key]
        at += size


def test_pieces_of_latin_texts_equal_the_library():
    random.seed(11)
    parts = ["a", "The", " ", "\n", "é", "É", "ß", "ª", "²", "½", "1", "23", "_", "'s", "'S", "'ll", "'", "n't", ".", "$$$", "\xa0", "\x85", "\x01", "\xad", "Ǆ", "ſ", "ǅ", "×"]
    texts = ["".join(random.choice(parts) * random.choice([1, 1, 2, 3]) for _ in range(random.randint(0, 20))) for _ in range(4000)]
    assert not any(token_store.OTHER.search(t) for t in texts)
    tool, library = token_store.Encoder(token_store.vocabulary()), Tokenizer.from_file(token_store.vocabulary())
    got = [ids for step in token_store.steps(texts) for ids in tool.encode(step)]
    for text, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_tokens_with_ties_and_nulls(docs):
    make = lambda key, text: (key, text, "en", "s", 1, *["x"] * 6)
    rows = [make(5, "b c"), make(None, "null key"), make(5, "a"), make(1, None), *[make(3, "same words here")] * 60]
    found = token_store.written_and_read(docs(None, rows).repartition(4), token_store.vocabulary()).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in found) == Counter(plain_store([(r[0], r[1]) for r in rows]))
    found.sort(key=lambda r: r.start)
    assert [r.start for r in found] == [0, *np.cumsum([r.n_tokens for r in found])[:-1].tolist()]
    keys = [r.doc_id for r in found]
    assert keys[0] is None and keys[1:] == sorted(keys[1:])
    assert token_store.written_and_read(docs([]), token_store.vocabulary()).count() == 0


def test_token_files_have_stripes_indexes_and_filters(spark, docs):
    path = scratch_path(spark, "tokens")
    random.seed(8)
    texts = [" ".join(str(random.randint(0, 10**6)) for _ in range(30)) for _ in range(40_000)]
    token_store.write_tokens(docs(texts), path, token_store.vocabulary(), stripe=1 << 16, stride=1000)
    files = [orc.ORCFile(f) for f in sorted(glob.glob(f"{path}/*.orc"))]
    # Several stripes in a file, so several tasks can read it.
    assert max(f.nstripes for f in files) > 1 and sum(f.nrows for f in files) == 40_000
    read = token_store.read_tokens(spark, path)
    assert read.schema["ids"].dataType.simpleString() == "array<int>"
    few = token_store.find_tokens(spark, path, [5, 39_999, 10**9])
    assert sorted(r.doc_id for r in few.collect()) == [5, 39_999]
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(doc_id" in plan
    # The filter reaches the files' own statistics and Bloom filters: the scan reads few row groups.
    scan = few._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    assert 0 < scan.metrics().apply("numOutputRows").value() <= 3000
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        assert token_store.read_tokens(spark, path).rdd.getNumPartitions() > len(files)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


# --- 13 ------------------------------------------------------------------------------------------


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(leaves):
    """Levels of a tree from the leaves up, and the siblings of each leaf."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([sha("".join(now[i : i + 3])) for i in range(0, len(now), 3)])
    proofs = []
    for place in range(len(leaves)):
        proof = []
        for level in levels[:-1]:
            first = place - place % 3
            run = list(range(first, min(first + 3, len(level))))
            proof.append(([level[i] for i in run if i < place], [level[i] for i in run if i > place]))
            place //= 3
        proofs.append(proof)
    return levels[-1][0], proofs


def plain_manifest(rows):
    """Rows are (doc_id, source, lang, n_chars, text): sorted rows of the op13 query."""
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, plain_leaf(row), row))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {name: plain_tree([x[2] for x in sorted(groups[name], key=lambda x: x[:3])]) for name in names}
    root, upper = plain_tree([trees[n][0] for n in names]) if names else (None, [])
    out = []
    for name, above in zip(names, upper):
        subroot, proofs = trees[name]
        for (_, _, leaf, row), proof in zip(sorted(groups[name], key=lambda x: x[:3]), proofs):
            proof = proof + above
            claim = leaf
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[4] is not None:
                claim = plain_leaf((*row[:4], row[4].replace("\n", "")))
            for left, right in proof:
                claim = sha("".join([*left, claim, *right]))
            siblings = sha("".join(x for left, right in proof for x in left + right))
            out.append((row[0], leaf, subroot, root, siblings, claim, claim == root))
    return sorted(out, key=repr)


def manifest_of(spark, tmp_path, rows):
    frame = pd.DataFrame(rows, columns=["doc_id", "source", "lang", "n_chars", "text"])
    frame["doc_id"], frame["n_chars"] = frame["doc_id"].astype("Int64"), frame["n_chars"].astype("Int64")
    frame.to_parquet(tmp_path / "documents.parquet")
    schema = "doc_id LONG, source STRING, lang STRING, n_chars LONG, text STRING"
    found = spark.read.schema(schema).parquet(str(tmp_path / "documents.parquet"))
    assert found.count() == len(rows)
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = QUERIES["op13_merkle_manifest"](spark, str(tmp_path)).select(names).collect()
    return sorted(map(tuple, got), key=repr)


def manifest_rows(n, sources, seed=3):
    random.seed(seed)
    rows = []
    for i in range(n):
        text = random.choice([None, "", "no line end", "one\ntwo\n", f"text {i}\n", "日本\n" * 3])
        rows.append((i * 7 % n, random.choice(sources), random.choice([None, "en", "日本"]), None if text is None else len(text), text))
    return rows


@pytest.mark.parametrize("n, sources", [(1, ["s"]), (2, ["s"]), (3, ["a", "b"]), (40, ["only"]), (300, [None, "", "a", "é", "b", "z", "=x"]), (2300, [None, "hot"])])
def test_manifest_equals_brute_force(spark, tmp_path, n, sources):
    rows = manifest_rows(n, sources)
    assert manifest_of(spark, tmp_path, rows) == plain_manifest(rows)


def test_manifest_of_odd_keys(spark, tmp_path):
    rows = manifest_rows(30, [None, "a"]) + [(None, "a", "en", 1, "x\n"), (None, None, None, None, None), (4, "a", "en", 2, "y\n")]
    rows += [(4, "a", "en", 2, "y\n")] * 9
    assert manifest_of(spark, tmp_path, rows) == plain_manifest(rows)


def test_manifest_of_many_sources(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(merkle, "DEPTH", 1)
    rows = manifest_rows(60, [f"s{i}" for i in range(30)])
    assert manifest_of(spark, tmp_path, rows) == plain_manifest(rows)


def test_manifest_ignores_other_columns_and_empty_tables(docs):
    assert merkle.manifest(docs([])).count() == 0
    found = merkle.manifest(docs(["a", "b"]), fields=("doc_id", "text"), keep={"size": F.col("size")}).collect()
    assert [r.size for r in found] == ["x", "x"] and len({r.root for r in found}) == 1
    for r in found:
        assert merkle.fold(r.leaf, r.proof) == r.root


def test_given_documents(spark, sf_dir):
    """Whole tables: all three queries give each document once."""
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = QUERIES["op13_merkle_manifest"](spark, sf_dir).select(names).collect()
    assert sorted(map(tuple, got), key=repr) == plain_manifest(rows)
    by_key = sorted((r[0], r[4]) for r in rows)
    at = 0
    for row, want in zip(sorted(QUERIES["op12_orc_tokens"](spark, sf_dir).collect()), plain_store(by_key), strict=True):
        assert row == (want[0], at, *want[1:])
        at += want[1]
    aligned = {r.doc_id: r for r in QUERIES["op11_galloping_alignment"](spark, sf_dir).collect()}
    plain = Plain()
    assert len(aligned) == len(rows)
    for key, text in by_key:
        a, b = plain.tokens(text)
        assert (aligned[key].n_a, aligned[key].n_b) == (len(a), len(b))
