"""Spelling variants by reduced alphabets: letters are hashed to a few symbols, the one-edit neighbourhoods of the reduced
words are generated and joined with the reduced vocabulary, and what meets is verified on the words themselves."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASES, Rolling, batch, lean, mix, stage, unstage

#: Words that a task counts before it sends them on; letters whose neighbourhoods are in memory at once.
HELD, LETTERS = 200_000, 100_000
#: Symbols of the alphabets, in the order in which they are tried; the last tells all letters apart.
ALPHABETS = (8, 32, 0)
#: Pairs that two reduced words may make; those with more go on to the next alphabet.
CELL = 1 << 14
_LAST = np.array([*range(97, 123), *range(0xC0, 0x100)], np.uint64)


def word_counts(docs: DataFrame, shortest: int = 6, damage: int = 199) -> DataFrame:
    """word and n: the runs of letters of all texts, with only A-Z lowered, counted.

    Where `damage` divides the CRC-32 h of "<doc_id>:<run>", the run's code point h % length is deleted first (0: none
    is). Words are of `shortest` code points at least. A null text has no runs; a null doc_id stands in the CRC-32 as an
    empty text. Each task sends a word's count once for every HELD words it holds."""
    lean(docs.sparkSession)
    runs = re.compile("[a-zÀ-ÿ]{%d,}" % shortest)

    def out(held: Counter) -> pa.RecordBatch:
        return batch(["word", "n"], pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for one in batches:
            for name, text in zip(one.column(0).to_pylist(), one.column(1), strict=True):
                if not text.is_valid:
                    continue
                own = Counter(runs.findall(text.as_py().encode().lower().decode()))
                if damage:
                    seed = zlib.crc32(f"{'' if name is None else name}:".encode())
                    for word, n in list(own.items()):
                        h = zlib.crc32(word.encode(), seed)
                        if h % damage == 0:
                            at = h % len(word)
                            del own[word]
                            if len(word) > shortest:
                                held[word[:at] + word[at + 1 :]] += n
                held.update(own)
                if len(held) >= HELD:
                    yield out(held)
                    held.clear()
        yield out(held)

    parts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


_rolling = Rolling(BASES[0])


def _symbols(alphabet: int) -> np.ndarray:
    """Values of the alphabet's symbols, in order."""
    return mix(_LAST if not alphabet else np.arange(1, alphabet + 1, dtype=np.uint64) * np.uint64(BASES[1]))


def _reduced(words: list[str], alphabet: int) -> tuple[np.ndarray, np.ndarray]:
    """The number of each letter's symbol, and n + 1 offsets of the words."""
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    at = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    return np.searchsorted(_LAST, letters) if not alphabet else (mix(letters * np.uint64(BASES[2])) % np.uint64(alphabet)).astype(np.int64), at


def _keys(words: list[str], alphabet: int) -> np.ndarray:
    number, at = _reduced(words, alphabet)
    prefix = _rolling.prefix(_symbols(alphabet)[number])
    return _rolling.windows(prefix, at[:-1], at[1:])


def neighbours(words: list[str], alphabet: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of reduced words one edit from those of `words`, and the index of the word each comes from. Of two reduced
    words the longer one gives the shorter (by a deletion), of two as long the lesser the greater (by a replacement), so
    all neighbourhoods together hold each pair once; every word gives itself too. A neighbour's hash follows from prefix
    sums, so a word of L letters takes L times the alphabet's size, however long it is."""
    number, at = _reduced(words, alphabet)
    values = _symbols(alphabet)
    prefix = _rolling.prefix(values[number])
    up, down = _rolling.up, _rolling.down
    start, end = at[:-1], at[1:]
    own = (prefix[end] - prefix[start]) * down[start]
    of = np.repeat(np.arange(len(words)), end - start)
    j, s, e = np.arange(len(number)), start[of], end[of]
    less = (prefix[j] - prefix[s]) * down[s] + (prefix[e] - prefix[j + 1]) * down[np.minimum(s + 1, len(down) - 1)]
    # of a run of one symbol every deletion is the same
    once = (j == s) | (number != np.concatenate([number[:1], number[:-1]]))
    hashes, index = [own, less[once]], [np.arange(len(words)), of[once]]
    for symbol in range(1, len(values)):
        greater = number < symbol
        hashes.append(own[of[greater]] + (values[symbol] - values[number[greater]]) * up[(j - s)[greater]])
        index.append(of[greater])
    return mix(np.concatenate(hashes)), np.concatenate(index)


def _slices(words: list[str]) -> Iterator[slice]:
    start, size = 0, 0
    for k, word in enumerate(words):
        size += len(word)
        if size >= LETTERS:
            yield slice(start, k + 1)
            start, size = k + 1, 0
    if start < len(words):
        yield slice(start, len(words))


def near_pairs(vocabulary: DataFrame, alphabets: tuple[int, ...] = ALPHABETS) -> DataFrame:
    """All pairs (a, n_a, b, n_b) of words of vocabulary (word, n) that differ by one inserted, deleted or replaced code
    point, each once.

    Reduced words, not words, meet their neighbours; what they stand for is paired only where two of them make at most
    CELL pairs. The words of the others are paired by the next, larger alphabet; under the last one every word is a
    reduced word of its own. Words are of letters a-z and U+00C0 to U+00FF."""
    alphabet, rest = alphabets[0], alphabets[1:]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in batches:
            words = one.column(0).to_pylist()
            for cut in _slices(words):
                yield batch(["word", "n", "key"], one.column(0)[cut], one.column(1)[cut], _keys(words[cut], alphabet).view(np.int64))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in batches:
            words = one.column(1).to_pylist()
            for cut in _slices(words):
                to, of = neighbours(words[cut], alphabet)
                for some in range(0, len(to), 1 << 20):
                    picked = pa.array(of[some : some + (1 << 20)])
                    yield batch(["to", "key", "m"], to[some : some + (1 << 20)].view(np.int64), one.column(0)[cut].take(picked), one.column(2)[cut].take(picked))

    coded = stage(vocabulary.select("word", "n").mapInArrow(code, "word string, n long, key long"), "variants-coded")
    reduced = stage(coded.groupBy("key").agg(F.min("word").alias("word"), F.count("*").alias("m")), "variants-reduced")
    met = reduced.mapInArrow(spread, "to long, key long, m long").join(reduced.select(F.col("key").alias("to"), F.col("m").alias("m_to")), "to")
    links = stage(met.select("key", "to", (F.col("m") * F.col("m_to")).alias("pairs")), "variants-links")
    unstage(reduced)
    small = links if not rest else links.filter(F.col("pairs") <= CELL)
    side = lambda x, key: coded.select(F.col("key").alias(key), F.col("word").alias(x), F.col("n").alias(f"n_{x}"))
    both = small.select("key", "to").join(side("a", "key"), "key").join(side("b", "to"), "to")
    once = (F.col("key") != F.col("to")) | (F.col("a") < F.col("b"))
    found = both.filter(once & (F.levenshtein("a", "b", 1) == 1)).select("a", "n_a", "b", "n_b")
    if rest and (large := links.filter(F.col("pairs") > CELL)).limit(1).count():
        keys = large.select(F.explode(F.array("key", "to")).alias("key")).distinct()
        words = stage(coded.join(keys, "key", "left_semi").select("word", "n"), "variants-words")
        ordered = lambda df: df.select(F.least("a", "b").alias("a"), F.when(F.col("a") < F.col("b"), F.col("n_a")).otherwise(F.col("n_b")).alias("n_a"), F.greatest("a", "b").alias("b"), F.when(F.col("a") < F.col("b"), F.col("n_b")).otherwise(F.col("n_a")).alias("n_b"))
        return ordered(found).unionByName(ordered(near_pairs(words, rest))).distinct()
    return found


def spelling_variants(vocabulary: DataFrame, ratio: int = 5, alphabets: tuple[int, ...] = ALPHABETS) -> DataFrame:
    """word, form, root, n, n_near and form_n of each word of vocabulary (word, n; words once each).

    A word's form is its near word of largest n (of equals the least in code-point order), if that has `ratio` times the
    word's n at least, else null; its root is where its forms end, or itself. A form's n is `ratio` times its word's, so
    chains of forms are as short as a logarithm, and each round of looking up roots halves them. A word has at most some
    hundred near words for each of its letters, so no key of the counts is hot. An empty vocabulary gives no rows."""
    pairs = near_pairs(vocabulary, alphabets)
    sides = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("n")))
    best = pairs.select(F.explode(sides).alias("x")).select("x.*").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("m"), F.col("near").alias("form"))).alias("best"))
    led = -F.col("best.m") >= ratio * F.col("n")
    forms = stage(vocabulary.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(led, F.col("best.form")).alias("form"), F.when(led, -F.col("best.m")).alias("form_n")), "variants-forms")
    roots = stage(forms.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "variants-roots")
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = stage(roots.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "variants-roots")
        done = not moved.filter("moved").limit(1).count()
        unstage(roots)
        roots = moved.drop("moved")
        if done:
            break
    out = forms.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_reduced_alphabet(spark, sf_dir: str) -> DataFrame:
    words = word_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return spelling_variants(stage(words.filter("n >= 5"), "variants-vocabulary"))


OP13_SQL = """
WITH RECURSIVE crc AS (SELECT list(list_reduce(list_prepend(CAST(k AS BIGINT), list_transform(range(8), lambda i: CAST(i AS BIGINT))),
                 lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY k) AS t FROM range(256) AS r(k)),
runs AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]{6,}')) AS w FROM documents) GROUP BY ALL),
b AS (SELECT *, list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w)), '..'), lambda h: CAST('0x' || h AS BIGINT))) AS bytes FROM runs),
c AS (SELECT w, n, xor(list_reduce(bytes, lambda c, h: xor(c >> 8, t[xor(c & 255, h) + 1])), 4294967295) AS h FROM b, crc),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM c)
      WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
less AS (SELECT DISTINCT word, n, substr(word, 1, k) || substr(word, k + 2) AS x FROM v, unnest(range(length(word))) AS r(k)),
swap AS (SELECT word, n, substr(word, 1, k) || ' ' || substr(word, k + 2) AS x FROM v, unnest(range(length(word))) AS r(k)),
near AS (SELECT a.word, b.word AS other, b.n FROM less a JOIN v b ON a.x = b.word UNION ALL SELECT b.word, a.word, a.n FROM less a JOIN v b ON a.x = b.word
         UNION ALL SELECT a.word, b.word, b.n FROM swap a JOIN swap b ON a.x = b.x AND a.word <> b.word),
best AS (SELECT word, count(*) AS n_near, min({'m': -n, 'w': other}) AS b FROM near GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.m >= 5 * v.n THEN b.w END AS form, CASE WHEN -b.m >= 5 * v.n THEN -b.m END AS form_n FROM v LEFT JOIN best ON v.word = best.word),
walk AS (SELECT word, word AS at, form AS next FROM f UNION ALL SELECT walk.word, walk.next, f.form FROM walk JOIN f ON f.word = walk.next)
SELECT f.word, f.form, walk.at AS root, f.n, f.n_near, f.form_n FROM f JOIN walk ON walk.word = f.word AND walk.next IS NULL
"""
