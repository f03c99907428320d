"""What is done to the words of many texts at a time, in Arrow batches inside the tasks.

A function here makes another one, ``work(texts, table)``: from a list of texts (None for NULL) and a dictionary to a list
of results, None where the text is None. The dictionary is a model of checked size, or what a join found for the texts of a
block; see :mod:`geopulse.plans.blocks`. The made functions name nothing of this package, so the workers need not have it.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are handled as one array.
CHUNK = 200_000
AHEAD = 3


def reader():
    """Function from an Arrow array of strings to a list; bytes that are no UTF-8 become U+FFFD."""

    def read(array):
        try:
            return array.to_pylist()
        except UnicodeDecodeError:
            return [None if b is None else b.decode("utf-8", "replace") for b in array.cast(pa.binary()).to_pylist()]

    return read


def by_dictionary(work, table: dict, kind: str):
    """Column function: the work on a text with one dictionary for all."""
    read, types = reader(), {"string": pa.string(), "bigint": pa.int64()}

    @F.arrow_udf(kind)
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(work(read(texts), table), types[kind])

    return run


def replaced():
    """Blank-separated words, each as the dictionary has it."""

    def work(texts, table):
        get = table.get

        def one(text):
            words = text.split(" ")
            return " ".join(map(get, words, words))

        return [one(text) if text else text for text in texts]

    return work


def sums():
    """Sum of what the dictionary has for the blank-separated words."""

    def work(texts, table):
        get = table.get
        # What is not there or zero adds nothing.
        return [None if text is None else sum(filter(None, map(get, text.split(" ")))) for text in texts]

    return work


def chunked(cut, handle, chunk=CHUNK):
    """Work in chunks of about ``chunk`` words: ``cut`` makes the words of a text, ``handle`` the results of some lists of words."""

    def work(texts, *models):
        out, held, at, size = [None] * len(texts), [], [], 0
        for i, text in enumerate(texts):
            if text is None:
                continue
            held.append(cut(text))
            at.append(i)
            size += len(held[-1])
            if size >= chunk:
                for k, value in zip(at, handle(held, *models)):
                    out[k] = value
                held, at, size = [], [], 0
        if held:
            for k, value in zip(at, handle(held, *models)):
                out[k] = value
        return out

    return work


def array_tools(ahead=AHEAD):
    """``joined``: lists of numbers as one array with zeros after each, and where each begins; ``lag``: an array moved
    up; ``divided``: division that cuts towards zero. The zeros keep neighbours of different texts apart."""
    gap = [0] * ahead

    def joined(lists):
        flat, starts = [], []
        for one in lists:
            starts.append(len(flat))
            flat += one
            flat += gap
        return np.array(flat, dtype=np.int64), np.array(starts, dtype=np.int64)

    def lag(array, k):
        out = np.zeros_like(array)
        out[k:] = array[:-k]
        return out

    def divided(value, by):
        return np.sign(value) * (np.abs(value) // by)

    return joined, lag, divided


def rule_sums(parts: dict, negates: int, boosts, factors, scale: int, unit: int):
    """Sum of the valences of blank-separated words, adjusted by boosters and negators up to three words ahead.

    ``parts`` has the part of a word in the rules: 1 or -1 for a booster, ``negates`` for a negator."""
    joined, lag, divided = array_tools(max(AHEAD, len(boosts)))
    boosts, factors = [int(b) for b in boosts], np.array(factors, dtype=np.int64)

    def handle(lists, table):
        number, value, rule, known = {}, [0], [0], [False]

        class Numbers(dict):
            def __missing__(self, word):
                v = table.get(word)
                rule_of = parts.get(word, 0) if v is None else 0
                # Words that no rule knows are all the same.
                at = 0
                if v is not None or rule_of:
                    at = len(value)
                    value.append(0 if v is None else int(v))
                    rule.append(rule_of)
                    known.append(v is not None)
                self[word] = at
                return at

        number = Numbers()
        ids, starts = joined([[number[w] for w in words] for words in lists])
        v, r, k = np.array(value, dtype=np.int64)[ids], np.array(rule, dtype=np.int64)[ids], np.array(known)[ids]
        sign, total, negations = np.sign(v), v * (unit // 10), np.zeros_like(v)
        for n, micro in enumerate(boosts, 1):
            before = lag(r, n)
            total += np.where(np.abs(before) == 1, before * sign * (micro * 100), 0)
            negations += before == negates
        total = np.where(k, divided(total * factors[negations], scale), 0)
        return np.add.reduceat(total, starts).tolist()

    return chunked(lambda text: text.split(" "), handle)


def whole_sums(rules: dict, trie: dict, longest: int):
    """Sum of the valences of the words between white space, with all rules of the whole score.

    ``rules`` has its fixed values by name. ``trie`` maps the beginnings of phrases to the valence of the phrase, or None."""
    import re

    f = rules
    punctuation, parts, negates, contrast = f["punctuation"], f["parts"], f["negates"], f["contrast"]
    boosts, capitals, unit, scale = list(f["boosts"]), list(f["capitals"]), f["unit"], f["scale"]
    before_it, after_it = f["before"], f["after"]
    factors = np.array(f["factors"], dtype=np.int64)
    first_words = {path for path in trie if " " not in path}
    joined, lag, divided = array_tools(max(AHEAD, len(boosts), longest))
    words_of = re.compile(r"[^ \t\n\x0b\f\r]+").findall
    never = 1 << 60

    def handle(lists, table):
        value, rule, known, caps, begins, low = [0], [0], [False], [False], [False], [None]

        class Numbers(dict):
            def __missing__(self, raw):
                bare = raw.strip(punctuation)
                word = bare if len(bare) > 2 else raw
                lower = word.lower()
                v = table.get(lower)
                self[raw] = at = len(value)
                value.append(0 if v is None else int(v))
                rule.append(parts.get(lower, 0) if v is None else 0)
                known.append(v is not None)
                caps.append(lower != word and word.upper() == word)
                begins.append(lower in first_words)
                low.append(lower)
                return at

        number = Numbers()
        lists = [[number[w] for w in words] for words in lists]
        sizes = np.array([len(one) for one in lists], dtype=np.int64)
        ids, starts = joined(lists)
        v, r, k = np.array(value, dtype=np.int64)[ids], np.array(rule, dtype=np.int64)[ids], np.array(known)[ids]
        if longest:
            span = np.zeros(len(ids), dtype=np.int64)
            for i in np.flatnonzero(np.array(begins)[ids]).tolist():
                path, n = low[ids[i]], 1
                while path in trie:
                    if trie[path] is not None:
                        span[i], v[i] = n, int(trie[path])
                    if n == longest or low[ids[i + n]] is None:
                        break
                    path, n = f"{path} {low[ids[i + n]]}", n + 1
            inside = np.zeros(len(ids), dtype=bool)
            for n in range(1, longest):
                inside |= lag(span, n) > n
            k = ~inside & (k | (span > 0))
            r = np.where(inside | (span > 0), 0, r)
        v = np.where(k, v, 0)
        every = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(ids))))
        place = np.arange(len(ids)) - starts[every] + 1
        capital = np.array(caps)[ids]
        n_caps = np.add.reduceat(capital.astype(np.int64), starts)
        capital &= ((n_caps > 0) & (n_caps < sizes))[every]
        is_contrast = np.array([word == contrast for word in low])[ids]
        at = np.minimum.reduceat(np.where(is_contrast, place, never), starts)[every]
        sign = np.sign(v)
        total, negations = v * (unit // 10) + np.where(capital, sign * (capitals[0] * 100), 0), np.zeros_like(v)
        for n, (boost, capital_boost) in enumerate(zip(boosts, capitals), 1):
            ahead = lag(r, n)
            by = ahead * (boost * 100) + np.where(lag(capital, n), capital_boost * 100, 0)
            total += np.where(np.abs(ahead) == 1, sign * by, 0)
            negations += ahead == negates
        total = divided(total * factors[negations], scale)
        weight = np.where((at == never) | (place == at), 10, np.where(place < at, before_it, after_it))
        return np.add.reduceat(np.where(k, total * weight, 0), starts).tolist()

    return chunked(words_of, handle)
