"""Edit-aware token counts (operator 6).

A text is cut into leaves: runs of pre-tokens of about LEAF_CHARS characters. A cut lies
where the tokenizer's pattern always starts a new pre-token, so leaves are encoded on their
own: before a space that follows a non-space and precedes a non-space, and, for text without
spaces, where a letter, a digit or another sign follows one of another kind. No pre-token
holds two of these kinds but for contractions, which begin with an apostrophe: behind one
there is no cut. A longer run of one kind is one pre-token, hence one leaf. A binary tree holds
the leaves' token and character sums; it is kept in the row, inner sums included, in heap order. Some of its
slots are empty, so that leaves can be added in place: an edit re-encodes only the leaves that
it touches and the next to each side, deals them to the slots of the smallest subtree with
room, and the sums above follow.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import small_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF_CHARS = 256
# Letters, digits and the rest as far as every version of Unicode's tables knows them: ASCII, Latin, kana, Han, Thai.
_L, _N = r"A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u017F\u0E01-\u0E30\u3041-\u3096\u30A1-\u30FA\u4E00-\u9FA5", "0-9"
_O = r"!-&(-/:-@\[-`{-~\u3001-\u3003\u3008-\u3011\uFF01-\uFF0F\uFF1A-\uFF20"
CUT = regex.compile(rf"(?<=\S) (?=\S)|(?<=[{_L}])(?=[{_N}{_O}'])|(?<=[{_N}])(?=[{_L}{_O}'])|(?<=[{_O}])(?=[{_L}{_N}])")
EDIT = pa.struct([("at", pa.int64()), ("removed", pa.int64()), ("added", pa.string())])
TREE = "n_tokens long, n_chars long, tree_chars array<int>, tree_tokens array<int>"
FULL = 0.75  # the share of slots that may be taken in the whole tree; a single slot may be taken whole


@lru_cache(4)
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def cuts(text: str, leaf_chars: int = LEAF_CHARS) -> list[int]:
    """Where the leaves of text end; a run without a safe place stays one leaf."""
    ends, at, n = [], 0, len(text)
    while n - at > leaf_chars and (m := CUT.search(text, at + leaf_chars)):
        at = m.start()
        ends.append(at)
    if at < n:
        ends.append(n)
    return ends


class Tree:
    """Character and token sums in heap order: node i has the children 2i and 2i + 1, the slots of leaves
    are the last half, empty ones hold 0. `touched` counts nodes that were written since the tree was read."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.chars, self.tokens, self.width, self.touched = chars, tokens, len(chars) // 2, 0

    @classmethod
    def of(cls, leaves: list[tuple[int, int]]) -> Tree:
        tree = cls([0, 0], [0, 0])
        tree._fill(leaves)
        return tree

    @property
    def total(self) -> int:
        return self.tokens[1]

    def _fill(self, leaves: list[tuple[int, int]]) -> None:
        """The tree anew, of a width that leaves room."""
        self.width = 1
        while len(leaves) > FULL * self.width:
            self.width *= 2
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        self._deal(1, leaves)

    def _slots(self, node: int) -> tuple[int, int]:
        low, high = node, node + 1
        while low < self.width:
            low, high = 2 * low, 2 * high
        return low, high

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]
        self.touched += 1

    def _deal(self, node: int, leaves: list[tuple[int, int]]) -> None:
        """Spreads leaves over the slots below node; sums below and above follow."""
        low, high = self._slots(node)
        size = high - low
        self.touched += size
        self.chars[low:high] = self.tokens[low:high] = [0] * size
        for k, (chars, tokens) in enumerate(leaves):
            at = low + k * size // len(leaves)
            self.chars[at], self.tokens[at] = chars, tokens
        while low > node:
            low, high = low // 2, high // 2
            for i in range(low, high):
                self._sum(i)
        while node > 1:
            node //= 2
            self._sum(node)

    def leaves(self, low: int | None = None, high: int | None = None) -> list[tuple[int, int]]:
        """(chars, tokens) of the leaves in the slots from low on and before high, or in all."""
        part = slice(self.width if low is None else low, high)
        return [pair for pair in zip(self.chars[part], self.tokens[part], strict=True) if pair[0]]

    def leaf_at(self, at: int) -> tuple[int, int]:
        """(slot, its first character) of the leaf that holds character `at`, or the last leaf."""
        i, start = 1, 0
        while i < self.width:
            i *= 2
            if start + self.chars[i] <= at and self.chars[i + 1]:
                start += self.chars[i]
                i += 1
        return i, start

    def splice(self, first: int, last: int, fresh: list[tuple[int, int]]) -> None:
        """The leaves in the slots first to last become the given ones."""
        node, end = first, last
        while node != end:
            node, end = node // 2, end // 2
        while True:
            low, high = self._slots(node)
            leaves = self.leaves(low, first) + fresh + self.leaves(last + 1, high)
            height, top = (high - low).bit_length() - 1, max(1, self.width.bit_length() - 1)
            if len(leaves) <= (1 - (1 - FULL) * height / top) * (high - low):
                self._deal(node, leaves)
                return
            if node == 1:
                self._fill(leaves)
                return
            node //= 2


def build(text: str, encode, leaf_chars: int = LEAF_CHARS) -> Tree:
    return Tree.of(leaves_of(text, encode, leaf_chars))


def leaves_of(text: str, encode, leaf_chars: int = LEAF_CHARS) -> list[tuple[int, int]]:
    """(chars, tokens) of each leaf."""
    ends = cuts(text, leaf_chars)
    return [(b - a, len(encode(text[a:b]))) for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []


def edit(text: str, tree: Tree, at: int, removed: int, added: str, encode, leaf_chars: int = LEAF_CHARS) -> tuple[str, int]:
    """The edited text; updates the tree. Also returns how many characters were encoded again.

    A position beyond the text's end counts as its end, a removal ends with the text.
    """
    at = min(max(at, 0), len(text))
    removed = min(max(removed, 0), len(text) - at)
    after = text[:at] + added + text[at + removed :]
    if not text:
        tree.splice(tree.width, 2 * tree.width - 1, leaves_of(after, encode, leaf_chars))
        return after, len(after)
    # A leaf's end is safe because of the characters around it: the leaves next to the edit go too.
    low, start = tree.leaf_at(max(0, at - 1))
    if start:
        low, start = tree.leaf_at(start - 1)
    high, last = tree.leaf_at(min(len(text) - 1, at + removed + 1))
    if last + tree.chars[high] < len(text):
        high, last = tree.leaf_at(last + tree.chars[high])
    piece = after[start : last + tree.chars[high] - removed + len(added)]
    tree.splice(low, high, leaves_of(piece, encode, leaf_chars))
    return after, len(piece)


def _counter(path: str, leaf_chars: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_ordinary
        for batch in batches:
            texts = [x.as_py() or "" for x in batch.column(batch.schema.get_field_index("text"))]
            trees = [build(t, encode, leaf_chars) for t in texts]
            whole = pa.list_(pa.int32())
            extra = {"n_tokens": pa.array([t.total for t in trees], pa.int64()), "n_chars": pa.array([len(t) for t in texts], pa.int64()), "tree_chars": pa.array([t.chars for t in trees], whole), "tree_tokens": pa.array([t.tokens for t in trees], whole)}
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra.values()], names=[*batch.schema.names, *extra])

    return count


def token_trees(docs: DataFrame, vocabulary: str = VOCABULARY, leaf_chars: int = LEAF_CHARS, keep: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, the columns in `keep`, n_tokens, n_chars, tree_chars, tree_tokens of every row.

    The last two are the tree in heap order. A null text is empty and has no leaf. Rows may repeat and ids may be null. `keep` may not
    name a column of the result. vocabulary: a rank file at this path on every executor.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *keep)
    shape = ", ".join(f"`{name}` {kind}" for name, kind in rows.dtypes)
    return small_batches(rows).mapInArrow(_counter(vocabulary, leaf_chars), f"{shape}, {TREE}")


def _updater(path: str, leaf_chars: int):
    def update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_ordinary
        for batch in batches:
            column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            rows = []
            for i in range(batch.num_rows):
                text = column["text"][i].as_py() or ""
                tree = Tree(column["tree_chars"][i].as_py(), column["tree_tokens"][i].as_py())
                before, again = tree.total, 0
                for e in column["edits"][i].as_py() or ():
                    if e is not None:
                        text, n = edit(text, tree, e["at"] or 0, e["removed"] or 0, e["added"] or "", encode, leaf_chars)
                        again += n
                rows.append((column["doc_id"][i].as_py(), before, tree.total, len(text), again, tree.touched, text, tree.chars, tree.tokens))
            kinds = (*[pa.int64()] * 6, pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            names = ["doc_id", "tokens_before", "n_tokens", "n_chars", "chars_encoded", "nodes_written", "text", "tree_chars", "tree_tokens"]
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return update


def apply_edits(trees: DataFrame, vocabulary: str = VOCABULARY, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """Applies `edits` (array<struct<at,removed,added>>, in order) of each row of token_trees.

    doc_id, tokens_before, n_tokens, n_chars, chars_encoded, nodes_written, text and the updated tree.
    A null or empty list changes nothing; null fields of an edit count as 0 and ''.
    """
    return small_batches(trees).mapInArrow(_updater(vocabulary, leaf_chars), "doc_id long, tokens_before long, n_tokens long, n_chars long, chars_encoded long, nodes_written long, text string, tree_chars array<int>, tree_tokens array<int>")


def leaf_count(tree_chars: Column) -> Column:
    """How many leaves a kept tree has."""
    width = (F.size(tree_chars) / 2).cast("int")
    return F.size(F.filter(F.slice(tree_chars, width + 1, width), lambda n: n > 0)).cast("long")
