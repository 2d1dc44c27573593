"""Benchmark decontamination by pigeonhole edit matching (operator 1).

A test item with an error budget of k edits is split into k + 1 pieces: in any occurrence
with at most k edits, one piece stands unchanged. One automaton finds the exact hits of all
pieces of a block of items in a document. A hit is verified by Myers' bit-parallel distance
on ever larger parts of the item (a part of p pieces may have p - 1 edits), so that chance
hits fall after a short comparison. Where all parts pass, the whole item is compared, once
for all places that overlap; an item with so many hits that verifying them costs more than
comparing it with the whole text is compared with that instead.

Texts are compared in lower case with white space runs folded to one space.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import materialize, small_batches

#: Characters of items in one broadcast block; a larger benchmark takes more passes.
BLOCK_CHARS = 2_000_000
#: Folded characters below which an item has to begin and end where words do.
WORDS_BELOW = 24
MEMO = 1 << 17
SCHEMA = "doc_id long, item_id long, distance int, match_start long, match_end long"


def fold(text: str) -> str:
    return " ".join(text.lower().split())


def places(pattern: str) -> dict[str, int]:
    """Of each character the bits at which it stands in pattern."""
    found: dict[str, int] = {}
    for i, c in enumerate(pattern):
        found[c] = found.get(c, 0) | 1 << i
    return found


def distance(pattern: str, text: str, most: int, anchored: bool = False, at: dict[str, int] | None = None) -> tuple[int, int]:
    """Myers: (least edit distance of pattern to a substring of text, where the first such one ends).

    The distance is most + 1 or more if no substring is within `most` edits. anchored: the
    substring begins where text begins. at: places(pattern), if known.
    """
    m = len(pattern)
    full, high, carry = (1 << m) - 1, 1 << (m - 1), int(anchored)
    vp, vn, score, best, end = full, 0, m, m, 0
    get = (places(pattern) if at is None else at).get
    for i, c in enumerate(text, 1):
        eq = get(c, 0)
        xv = eq | vn
        xh = (((eq & vp) + vp) ^ vp) | eq
        ph = vn | (~(xh | vp) & full)
        mh = vp & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
            if score < best:
                best, end = score, i
                if not best:
                    break
        ph = (ph << 1 | carry) & full
        vp = (mh << 1 & full) | (~(xv | ph) & full)
        vn = ph & xv
    return best, end


def edits(a: str, b: str) -> int:
    """The edit distance of two short strings."""
    row = range(len(b) + 1)
    for i, p in enumerate(a, 1):
        after = [i]
        for j, c in enumerate(b, 1):
            after.append(min(row[j] + 1, after[-1] + 1, row[j - 1] + (p != c)))
        row = after
    return row[-1]


def pieces(item: str, budget: int) -> list[tuple[int, int]]:
    """The budget + 1 almost equal (start, end) pieces of an item."""
    n = budget + 1
    return [(len(item) * i // n, len(item) * (i + 1) // n) for i in range(n)]


class Matcher:
    """Items of one block, their pieces and the automaton over the pieces."""

    def __init__(self, items: list[tuple[int, str]], rate: float, words_below: int):
        self.items = []
        self.automaton = ahocorasick.Automaton()
        where: dict[str, list[tuple[int, int]]] = {}
        for item_id, item in items:
            short = len(item) < words_below
            cut = pieces(item, int(len(item) * rate))
            for k, (a, b) in enumerate(cut):
                where.setdefault(item[a:b], []).append((len(self.items), k))
            self.items.append((item_id, item, cut, short))
        for piece, owners in where.items():
            self.automaton.add_word(piece, (len(piece), owners))
        if where:
            self.automaton.make_automaton()
        self.known: dict[int, dict[str, int]] = {}

    def _parts_pass(self, i: int, k: int, text: str, offset: int, memo: dict) -> tuple[bool, int]:
        """Whether the parts around piece k, doubled up to but without the whole, stand in text where the
        item would begin at `offset`; how many characters were compared."""
        _, item, cut, _ = self.items[i]
        path = []
        a, b = 0, len(cut)
        while b - a > 1:  # the halvings that lead to the piece
            middle = (a + b) // 2
            a, b = (a, middle) if k < middle else (middle, b)
            path.append((a, b))
        spent = 0
        for low, high in reversed(path[:-1]):
            passed = memo.get((i, offset, low, high))
            if passed is None:
                most = high - low - 1
                start = max(0, offset + cut[low][0] - most)
                window = text[start : max(start, offset + cut[high - 1][1] + most)]
                spent += len(window)
                passed = distance(item[cut[low][0] : cut[high - 1][1]], window, most)[0] <= most
                if len(memo) > MEMO:
                    memo.clear()
                memo[i, offset, low, high] = passed
            if not passed:
                return False, spent
        return True, spent

    def _best(self, i: int, text: str, windows: list[tuple[int, int]]) -> tuple[int, int, int] | None:
        """(distance, start, end) of the item's best match in the windows of text."""
        _, item, cut, _ = self.items[i]
        most = len(cut) - 1
        at = self.known.get(i)
        if at is None:
            at = self.known[i] = places(item)
        best = (most + 1, 0)
        for low, high in windows:
            d, end = distance(item, text[low:high], most, at=at)
            best = min(best, (d, low + end))
            if not best[0]:
                break
        d, end = best
        if d > most:
            return None
        # Where it starts: the same from the right, from its end on.
        back = text[max(0, end - len(item) - d) : end][::-1]
        return d, end - distance(item[::-1], back, d, anchored=True)[1], end

    def _best_of_words(self, i: int, text: str, windows: list[tuple[int, int]]) -> tuple[int, int, int] | None:
        """(distance, start, end) of the best match that begins and ends where words do; for items of few characters."""
        _, item, cut, _ = self.items[i]
        most, found = len(cut) - 1, []
        for low, high in windows:
            if distance(item, text[low:high], most)[0] > most:
                continue
            ends = [e for e in range(low + 1, high + 1) if not text[e : e + 1].isalnum()]
            for start in range(low, high):
                if start and text[start - 1].isalnum():
                    continue
                first = bisect_left(ends, start + len(item) - most)
                for end in ends[first : bisect_right(ends, start + len(item) + most)]:
                    found.append((edits(item, text[start:end]), end, end - start))
        if not found or min(found)[0] > most:
            return None
        d, end, length = min(found)
        return d, end - length, end

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, start, end) of the best match of each item; offsets are in the folded text."""
        if not self.items:
            return []
        passed: dict[int, set[int]] = {}
        spent: dict[int, int] = {}
        found: dict[int, tuple[int, int, int]] = {}
        memo: dict[tuple[int, int, int, int], bool] = {}
        n = len(text)
        for last, (length, owners) in self.automaton.iter(text):
            for i, k in owners:
                _, item, cut, short = self.items[i]
                at = last - length + 1
                if len(cut) == 1:
                    bounded = not short or not (text[at - 1 : at].isalnum() or text[last + 1 : last + 2].isalnum())
                    if bounded and i not in found:
                        found[i] = (0, at, last + 1)
                    continue
                offset = at - cut[k][0]
                own = passed.setdefault(i, set())
                used = spent.get(i, 0)
                if used > n or offset in own:
                    continue
                good, more = self._parts_pass(i, k, text, offset, memo)
                spent[i] = used + more
                if good:
                    own.add(offset)
        for i, offsets in passed.items():
            _, item, cut, _ = self.items[i]
            if spent.get(i, 0) > n:
                windows = [(0, n)]
            else:
                windows, slack = [], len(cut) - 1
                for offset in sorted(offsets):
                    low, high = max(0, offset - slack), min(n, offset + len(item) + slack)
                    if windows and low <= windows[-1][1]:
                        windows[-1] = (windows[-1][0], high)
                    else:
                        windows.append((low, high))
            best_of = self._best_of_words if self.items[i][3] else self._best
            if windows and (best := best_of(i, text, windows)):
                found[i] = best
        return [(self.items[i][0], *x) for i, x in sorted(found.items())]


def _scan(shared):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(*shared.value)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                if text:
                    rows += [(doc_id, *x) for x in matcher.matches(fold(text))]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "distance", "match_start", "match_end"])

    return scan


def _item_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The distinct items with a character, folded, in one or more blocks of about block_chars characters."""
    items = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).where("text is not null").distinct()
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_chars))
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        folded = {(r["item_id"], fold(r["text"])) for r in rows}
        yield sorted(((i, t) for i, t in folded if t), key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def find_contamination(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, words_below: int = WORDS_BELOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, distance, match_start, match_end: one row per document and item it holds.

    An item of n folded characters is held by a text with a substring within floor(rate * n)
    edits; of an item's matches in a text the one with the fewest edits counts, then the one
    that ends first, then the shortest. Of an item of fewer than words_below folded characters
    only matches that no letter or digit precedes or follows count. Null and blank
    items match nothing; null and empty texts hold nothing. Repeated rows are reported each,
    an item that is given twice (same id and text) once. Offsets are in the folded text.
    Columns other than the named ones are ignored.

    The items go to the executors in blocks of at most about block_chars characters, one
    pass over docs per block. With more than one block each pass is written before the next
    block is read, so neither the driver nor a broadcast grows with the benchmark.
    """
    spark = docs.sparkSession
    rows = small_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    return _by_blocks(spark, _item_blocks(benchmark, item_col, item_text_col, block_chars), lambda shared: rows.mapInArrow(_scan(shared), SCHEMA), rate, words_below)


def _by_blocks(spark, blocks: Iterator[list[tuple[int, str]]], scan, rate: float, words_below: int) -> DataFrame:
    """The rows of scan(broadcast) for all blocks; each but an only one is written before the next is read."""
    done: list[DataFrame] = []
    block = next(blocks)
    while block is not None:
        following = next(blocks, None)
        shared = spark.sparkContext.broadcast((block, rate, words_below))
        found = scan(shared)
        if done or following is not None:
            found = materialize(found, "block")
            shared.destroy()
        done.append(found)
        block = following
    return reduce(DataFrame.unionByName, done)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, words_below: int = WORDS_BELOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs, with all their columns, whose text holds no item; see find_contamination.

    With one block the decision is taken where a row is read: texts aren't shuffled. With
    more, each pass writes the MD5 of the texts that hold an item, and rows with one of them go.
    """
    column = docs.columns.index("text")
    blocks = _item_blocks(benchmark, "item_id", "text", block_chars)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        shared = docs.sparkSession.sparkContext.broadcast((first, rate, words_below))

        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(*shared.value)
            for batch in batches:
                keep = [not (t and matcher.matches(fold(t))) for t in (x.as_py() for x in batch.column(column))]
                yield batch.filter(pa.array(keep, pa.bool_()))

        return small_batches(docs).mapInArrow(clean, docs.schema)

    def held(shared) -> DataFrame:
        def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(*shared.value)
            for batch in batches:
                keep = [bool(t and matcher.matches(fold(t))) for t in (x.as_py() for x in batch.column(1))]
                yield batch.filter(pa.array(keep, pa.bool_())).select([0])

        return small_batches(docs.select(F.md5("text").alias("held"), "text")).mapInArrow(texts, "held string").distinct()

    rest = (b for part in ([first, second], blocks) for b in part)
    found = materialize(_by_blocks(docs.sparkSession, rest, held, rate, words_below).distinct(), "held")
    return docs.join(found, F.md5(docs["text"]) == found["held"], "left_anti")
