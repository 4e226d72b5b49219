"""Token ids of the public byte-level BPE vocabulary, and edit-aware token counts.

Edit-aware counting: each document keeps a segment tree over blocks of pre-tokens; an edit re-encodes only the blocks it
touches plus one block of context on either side, and updates the sums above them.
"""

from __future__ import annotations

import base64
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k.json"
#: Pre-tokens in a leaf of a document's tree.
LEAF = 64
#: Outside this range, and where a special token's name stands in a text, the ids come from the slower library.
_PLAIN = re.compile("[　-\U0010ffff]|<\\|endoftext\\|>")
#: White space as the vocabulary's pattern means it.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: White space of this length is too deep for the fast encoder's matcher.
LONG_WHITE = 10_000
_LONG = re.compile(f"(?<![{WHITE}])[{WHITE}]{{{LONG_WHITE}}}")


class Vocabulary:
    """Ids as Tokenizer.from_file(path).encode(text, add_special_tokens=False) gives them.

    tiktoken reads the same merges as ranks and is four times as fast; the tests hold the two equal for every code point
    below U+3000. Other texts, and those with very long white space, go to tokenizers itself."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.exact, self.ordinary = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.ordinary.encode_special_tokens = True
        ranks = dict(line.split() for line in open(path.removesuffix(".json") + ".tiktoken", "rb"))
        ranks = {base64.b64decode(token): int(rank) for token, rank in ranks.items()}
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @staticmethod
    def at(path: str) -> "Vocabulary":
        """One for each process."""
        kept = sys.__dict__.setdefault("_lanewise_vocabularies", {})
        if path not in kept:
            kept[path] = Vocabulary(path)
        return kept[path]

    def ids(self, text: str) -> list[int]:
        if _PLAIN.search(text) or self.deep(text):
            return self.exact.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    def count(self, text: str) -> int:
        """Tokens of the text, in which special tokens' names are ordinary text."""
        return len(self.ordinary.encode(text, add_special_tokens=False).ids if self.deep(text) else self.fast.encode_ordinary(text))

    @staticmethod
    def deep(text: str) -> bool:
        return len(text) >= LONG_WHITE and _LONG.search(text) is not None


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


@dataclass
class TokenTree:
    """Token counts of a text: leaves of whole pre-tokens, and a heap of sums (node 1 is the root)."""

    chars: list[int] = field(default_factory=list)
    sums: list[int] = field(default_factory=lambda: [0, 0])

    @property
    def count(self) -> int:
        return self.sums[1]

    def rebuild(self, counts: list[int]) -> None:
        size = 1
        while size < len(counts):
            size *= 2
        self.sums = [0] * size + counts + [0] * (size - len(counts))
        for node in range(size - 1, 0, -1):
            self.sums[node] = self.sums[2 * node] + self.sums[2 * node + 1]

    def counts(self) -> list[int]:
        half = len(self.sums) // 2
        return self.sums[half : half + len(self.chars)]

    def update(self, leaf: int, count: int) -> None:
        node = len(self.sums) // 2 + leaf
        change = count - self.sums[node]
        while node:
            self.sums[node] += change
            node //= 2


class Pretokens:
    """Cuts texts at pre-tokens, keeps trees of their counts and edits both."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex

        pattern = public_tokenizers.PATTERN.replace(r"[^\s", f"[^{WHITE}").replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]")
        self.pattern = regex.compile(pattern)
        self.vocabulary = Vocabulary.at(path)

    def count(self, text: str) -> int:
        return self.vocabulary.count(text) if text else 0

    def tree(self, text: str) -> TokenTree:
        out = TokenTree(self.leaves(text, 0, len(text)))
        out.rebuild(self.by_leaf(text, 0, out.chars))
        return out

    def leaves(self, text: str, left: int, right: int) -> list[int]:
        """Lengths of the leaves between two boundaries of pre-tokens."""
        return self.cut(text, left, iter([right]))[0] if left < right else []

    def cut(self, text: str, left: int, bounds: Iterator[int]) -> tuple[list[int], int]:
        """Lengths of the leaves from the boundary `left` on, up to the first of the ascending `bounds` at which a
        pre-token ends, and this bound. One pass over the text between."""
        out, last, n, bound = [], left, 0, next(bounds)
        for m in self.pattern.finditer(text, left):
            end, n = m.end(), n + 1
            while bound < end:
                bound = next(bounds)
            if n == LEAF or end == bound:
                out.append(end - last)
                last, n = end, 0
                if end == bound:
                    break
        return out, bound

    def by_leaf(self, text: str, at: int, chars: list[int]) -> list[int]:
        """Tokens of each leaf from `at` on. A run of white space looks at the character after it, so white space at a
        leaf's end is cut with that character in sight."""
        counts = []
        for size in chars:
            piece, after = text[at : at + size], text[at + size : at + size + 1]
            at += size
            body = piece.rstrip(WHITE)
            if len(body) == len(piece) or not after or after in WHITE:
                counts.append(self.count(piece))
                continue
            total = self.count(body)
            for m in self.pattern.finditer(piece + after, len(body)):
                if m.start() >= size:
                    break
                total += self.count(m.group())
            counts.append(total)
        return counts

    def edit(self, text: str, tree: TokenTree, start: int, end: int, new: str) -> tuple[str, int]:
        return self.edit_all(text, tree, [(start, end, new)])

    def edit_all(self, text: str, tree: TokenTree, edits: list[tuple[int, int, str]]) -> tuple[str, int]:
        """Replace text[start:end] by new for each of the disjoint edits; the tree follows. Returns the new text and how many
        characters were encoded. One sweep: leaves away from the edits keep their counts, and each stretch around edits is
        cut and encoded once, up to the first old boundary behind them at which a pre-token still ends."""
        if not edits:
            return text, 0
        edits = sorted(edits)
        start, end = (np.array([e[i] for e in edits], np.int64) for i in (0, 1))
        pieces, at = [], 0
        for a, b, new in edits:
            pieces += [text[at:a], new]
            at = b
        changed = "".join([*pieces, text[at:]])
        shift = np.concatenate([[0], np.cumsum([len(e[2]) - (e[1] - e[0]) for e in edits])])
        edges = np.concatenate([[0], np.cumsum(tree.chars, dtype=np.int64)])
        moved = edges + shift[np.searchsorted(end, edges, "right")]
        n, old = len(tree.chars), tree.counts()
        # the leaves around each edit, with context: before it up to one that isn't white, behind it one
        low = np.maximum(0, np.searchsorted(edges, start, "right") - 2).tolist()
        high = np.minimum(n, np.searchsorted(edges, end, "left") + 1).tolist()
        chars: list[int] = []
        counts: list[int] = []
        touched: list[tuple[int, int, int]] = []
        leaf = encoded = k = 0
        while k < len(edits):
            first = low[k]
            while first > leaf and not text[edges[first] : min(edges[first + 1], edits[k][0])].strip(WHITE):
                first -= 1
            first = max(first, leaf)
            reached = [high[k], k + 1]  # the least leaf to end at, and the next edit

            def bounds(reached: list[int] = reached) -> Iterator[int]:
                at = reached[0]
                while at < n:
                    while reached[1] < len(edits) and low[reached[1]] < at:
                        at = max(at, high[reached[1]])
                        reached[1] += 1
                    if at < n:
                        reached[0] = at
                        yield int(moved[at])
                        at += 1
                reached[:] = [n, len(edits)]
                yield len(changed)

            left = int(moved[first]) if first else 0
            found, right = self.cut(changed, left, bounds()) if left < len(changed) else ([], len(changed))
            if not found:
                reached[:] = [n, len(edits)]
            chars += tree.chars[leaf:first]
            counts += old[leaf:first]
            touched.append((len(chars), len(found), reached[0] - first))
            chars += found
            counts += self.by_leaf(changed, left, found)
            encoded += right - left
            leaf, k = reached
        chars += tree.chars[leaf:]
        counts += old[leaf:]
        tree.chars = chars
        if all(new == before for _, new, before in touched):
            for at, new, _ in touched:
                for i in range(at, at + new):
                    tree.update(i, counts[i])
        else:
            tree.rebuild(counts)
        return changed, encoded


EDITED = "doc_id bigint, n_tokens bigint, n_edits bigint, n_tokens_after bigint, n_chars_encoded bigint, leaf_chars array<int>, sums array<int>"
EDITS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())]))


def count_edited(docs: DataFrame, edits: str = "edits", path: str | None = None) -> DataFrame:
    """Token counts of each text before and after its edits.

    `edits` names a column array<struct<start:int,end:int,text:string>> of replacements in code points of the original
    text, which must not overlap; all are applied in one sweep. Special tokens' names in a text count as
    ordinary text. Returns both counts, the number of edits, the code points encoded again and the tree after the edits.
    Null texts are empty and have no tokens; null edits are none; an empty edit changes nothing; other columns are not
    read; repeated rows are rows of their own.
    """
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pretokens = Pretokens(path)
        for batch in batches:
            rows = []
            for doc, text, changes in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                text, changes = text.as_py() or "", changes.as_py() or []
                tree = pretokens.tree(text)
                before = tree.count
                _, encoded = pretokens.edit_all(text, tree, [(c["start"], c["end"], c["text"] or "") for c in changes])
                rows.append((doc, before, len(changes), tree.count, encoded, tree.chars, tree.sums))
            kinds = [pa.int64()] * 5 + [pa.list_(pa.int32())] * 2
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in EDITED.split(", ")])

    return docs.select(F.col("doc_id").cast("bigint"), "text", F.col(edits).cast("array<struct<start:int,end:int,text:string>>").alias("edits")).mapInArrow(run, EDITED)


def line_edits(text: str | None) -> list[dict]:
    """Deletes each \\n-split line with a word that equals an earlier line, with the \\n before it."""
    seen, out, at = set(), [], 0
    for line in (text or "").split("\n"):
        if line in seen:
            out.append({"start": at - 1, "end": at + len(line), "text": ""})
        elif line.strip():
            seen.add(line)
        at += len(line) + 1
    # neighbours become one edit
    joined: list[dict] = []
    for edit in out:
        if joined and joined[-1]["end"] == edit["start"]:
            joined[-1]["end"] = edit["end"]
        else:
            joined.append(edit)
    return joined


def with_line_edits(docs: DataFrame) -> DataFrame:
    """doc_id, text and the edits that delete repeated lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([line_edits(x.as_py()) for x in batch.column(1)], EDITS)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], ["doc_id", "text", "edits"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, text string, edits array<struct<start:int,end:int,text:string>>")


def op6_edit_aware(spark, sf_dir: str) -> DataFrame:
    """Counts of every document before and after deleting the lines that repeat an earlier one."""
    out = count_edited(with_line_edits(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return out.select("doc_id", "n_tokens", "n_edits", "n_tokens_after", "n_chars_encoded")
