"""Language identification by prediction by partial matching (operator 4).

Training counts, per language, which byte follows each context of 0 to ORDER bytes in a
bounded sample of labelled documents. Each language has a context tree of its own with a
bounded number of nodes, so more languages take nothing from one another. Its tables are sparse: of a context
they name the bytes that followed it, and three scalars that price the rest, by
PPM (escape method C, with exclusion) under the frozen counts. A text costs the sum of
its bytes' code lengths; the language with the shortest code wins.

Texts are coded in A-Z-insensitive form (lower case) as UTF-8 bytes. Scoring prices each
distinct run of a context and its next byte once and remembers it in a table of bounded
size, in pieces of bounded size, so a text of any length is coded whole in bounded memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import small_batches

ORDER = 4
#: Bounds of the training sample and of each language's tree, all parameters.
DOCS_PER_LANG, MAX_DOC_CHARS, MAX_NODES, LEAST_COUNT = 300, 16_384, 16_000, 6
UNIT = 1024  # code lengths are whole numbers of 1/1024 bit: sums are exact in any order
PIECE = 1 << 19
#: Bytes of the table of priced runs, and of the code lengths of one piece.
MEMORY = 32 << 20
BASE = 257  # a byte is the digit byte + 1 of a context's key, the last byte lowest; 0: before the text
LETTER = regex.compile(r"\p{L}")
UNDETERMINED = "und"


@dataclass
class Tree:
    """One language. contexts: sorted keys; per context: whole (log2 of what a byte's count is held against),
    escape, below and onward (as whole and escape, in the shorter context without the bytes known here).
    pairs: sorted context * BASE + digit of the next byte; log_n: log2 of its count."""

    contexts: np.ndarray
    whole: np.ndarray
    escape: np.ndarray
    below: np.ndarray
    onward: np.ndarray
    pairs: np.ndarray
    log_n: np.ndarray

    def nbytes(self) -> int:
        return sum(getattr(self, f.name).nbytes for f in fields(self))


@dataclass
class Model:
    """langs: names in order; trees: one of each."""

    langs: list[str]
    trees: list[Tree]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = DOCS_PER_LANG, max_doc_chars: int = MAX_DOC_CHARS) -> DataFrame:
    """text, lang: at most about docs_per_lang rows of each language from those that aren't held out.

    Rows without id, text or language aren't drawn; of a longer text the sample holds the
    first max_doc_chars characters. The draw depends on a hash of the id alone, and its share
    never becomes 0. The driver holds the languages' names and counts.
    """
    able = docs.where(~held_out(F.col(id_col)) & F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    space = 1 << 40
    shares = {r[0]: max(1, min(space, docs_per_lang * space // r[1])) for r in able.groupBy(F.col(lang_col).cast("string").alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()}
    drawn = able.select(F.substring(text_col, 1, max_doc_chars).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.pmod(F.xxhash64(F.col(id_col).cast("long"), F.lit(41)), F.lit(space)).alias("draw"))
    share = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair]) if shares else F.lit(None).cast("map<string,long>")
    return drawn.where(F.col("draw") < share[F.col("lang")]).select("text", "lang")


def _run_keys(digits: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Key of each digit and up to `order` before it; no context reaches over a 0."""
    key, alive = digits.copy(), digits != 0
    for back in range(1, order + 1):
        before = np.zeros_like(digits)
        before[back:] = digits[:-back]
        alive &= before != 0
        key += np.where(alive, before, 0) * BASE**back
    return key


def _digits(texts: list[bytes]) -> np.ndarray:
    """The digits of all bytes, with a 0 before each text."""
    lengths = np.array([len(t) for t in texts])
    digits = np.zeros(int(lengths.sum()) + len(texts), np.int64)
    own = np.ones(len(digits), bool)
    own[np.cumsum(lengths + 1) - lengths - 1] = False
    digits[own] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64) + 1
    return digits


def grow(texts: list[str], max_nodes: int = MAX_NODES, least_count: int = LEAST_COUNT) -> Tree | None:
    """The tree of one language: its most frequent contexts of all orders; None without a byte.

    A context is never more frequent than its shorter ones, so these are in the tree too.
    """
    digits = _digits([t.lower().encode() for t in texts])
    if not digits.any():
        return None
    runs, n = np.unique(_run_keys(digits)[digits != 0], return_counts=True)
    found = []
    for order in range(ORDER + 1):
        deep = runs >= BASE**order  # a run has so many bytes of context
        keys, where = np.unique(runs[deep] % BASE ** (order + 1), return_inverse=True)
        found.append((keys, np.bincount(where, n[deep], len(keys))))
    pairs, n = (np.concatenate(x) for x in zip(*found, strict=True))
    contexts, where = np.unique(pairs // BASE, return_inverse=True)
    seen, depth = np.bincount(where, n), sum((contexts >= BASE**k).astype(np.int64) for k in range(ORDER))
    able = (seen >= least_count) | (contexts == 0)
    rank = np.lexsort((contexts, depth, -seen))
    keep = np.zeros(len(contexts), bool)
    keep[rank[able[rank]][:max_nodes]] = True
    pairs, n = pairs[keep[where]], n[keep[where]]
    contexts, depth = contexts[keep], depth[keep]
    ahead = np.argsort(pairs)
    pairs, n = pairs[ahead], n[ahead]

    node = np.searchsorted(contexts, pairs // BASE)
    total, kinds = np.bincount(node, n, len(contexts)), np.bincount(node, minlength=len(contexts))
    shorter = contexts % BASE ** np.maximum(depth - 1, 0)
    parent = np.searchsorted(contexts, shorter)
    known = np.bincount(node, n[np.searchsorted(pairs, shorter[node] * BASE + pairs % BASE)], len(contexts))
    left, left_kinds = total[parent] - known, kinds[parent] - kinds
    none = left_kinds == 0  # also at the root, whose own bytes are all it knows
    below = np.log2(np.where(none, 1, left + left_kinds))
    whole = np.log2(total + kinds)
    numbers = (whole, whole - np.log2(kinds), below, np.where(none, 0, below - np.log2(np.where(none, 1, left_kinds))))
    return Tree(contexts, *(x.astype(np.float32) for x in numbers), pairs, np.log2(n).astype(np.float32))


def _grower(max_nodes: int, least_count: int):
    names = [f.name for f in fields(Tree)]

    def run(rows: pa.Table) -> pa.Table:
        tree = grow(rows.column("text").to_pylist(), max_nodes, least_count)
        cells = {"lang": pa.array(rows.column("lang").to_pylist()[:1], pa.string())}
        if tree is None:
            cells = {"lang": pa.array([], pa.string())}
        return pa.table(cells | {name: pa.array([getattr(tree, name).tobytes()] if tree else [], pa.binary()) for name in names})

    return run


def train(sample: DataFrame, max_nodes: int = MAX_NODES, least_count: int = LEAST_COUNT) -> Model | None:
    """The frozen model of (text, lang) rows; None without any text that has a byte.

    Each language grows in a task of its own from its bounded sample; the driver gathers the
    finished trees, whose sizes don't grow with the corpus (README: bytes by number of languages).
    """
    shape = "lang string, " + ", ".join(f"{f.name} binary" for f in fields(Tree))
    rows = sample.groupBy("lang").applyInArrow(_grower(max_nodes, least_count), shape).collect()
    wide = {"contexts", "pairs"}
    trees = {r["lang"]: Tree(*(np.frombuffer(r[f.name], np.int64 if f.name in wide else np.float32) for f in fields(Tree))) for r in rows}
    return Model(sorted(trees), [trees[x] for x in sorted(trees)]) if trees else None


def _at(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether it is there) of each wanted one among sorted keys."""
    place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return place, keys[place] == wanted


def price(tree: Tree, runs: np.ndarray) -> np.ndarray:
    """Code length, in 1/UNIT bits, of the last byte of each run."""
    context, digit = runs // BASE, runs % BASE
    place, hit = _at(tree.pairs, digit)
    after = np.full(len(runs), 8.0)  # after an escape from the root all 256 bytes are alike
    cost = np.where(hit, tree.whole[0] - tree.log_n[place], tree.escape[0] + after)
    for order in range(1, ORDER + 1):
        key = context % BASE**order
        node, inside = _at(tree.contexts, key)
        inside &= key >= BASE ** (order - 1)
        after = np.where(inside, np.where(hit, tree.below[node] - tree.log_n[place], tree.onward[node] + after), after)
        place, hit = _at(tree.pairs, key * BASE + digit)
        cost = np.where(inside, np.where(hit, tree.whole[node] - tree.log_n[place], tree.escape[node] + after), cost)
    return np.rint(cost * UNIT).astype(np.int32)


class Coder:
    """Code lengths of whole texts; runs that came before are looked up in a table of fixed size."""

    def __init__(self, model: Model, memory: int = MEMORY):
        self.model = model
        width = 4 * len(model.langs)
        self.bits = max(8, (memory // (width + 8)).bit_length() - 1)
        self.bits = min(self.bits, 18)
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.costs = np.zeros((1 << self.bits, len(model.langs)), np.int32)
        self.piece = max(ORDER + 1, min(PIECE, memory // width))

    def _costs(self, runs: np.ndarray) -> np.ndarray:
        """(runs, langs) code lengths."""
        slot = ((runs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
        missing = np.flatnonzero(self.keys[slot] != runs)
        result = self.costs.take(slot, axis=0)
        if len(missing):
            fresh, first, where = np.unique(runs[missing], return_index=True, return_inverse=True)
            found = np.stack([price(tree, fresh) for tree in self.model.trees], axis=1)
            result[missing] = found[where]
            slots, last = np.unique(slot[missing][first], return_index=True)  # one of the runs that share a slot
            self.keys[slots], self.costs[slots] = fresh[last], found[last]
        return result

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """(rows, langs) code lengths of whole texts in 1/UNIT bits."""
        result = np.zeros((len(texts), len(self.model.langs)), np.int64)
        i = 0
        while i < len(texts):
            if len(texts[i]) > self.piece:
                for at in range(0, len(texts[i]), self.piece):
                    low = max(0, at - ORDER)
                    digits = _digits([texts[i][low : at + self.piece]])
                    result[i] += self._costs(_run_keys(digits)[1 + at - low :]).sum(0, dtype=np.int64)
                i += 1
                continue
            j, total = i, 0
            while j < len(texts) and total + len(texts[j]) <= self.piece:
                total += len(texts[j]) + 1
                j += 1
            digits = _digits(texts[i:j])
            lengths = np.array([len(t) for t in texts[i:j]])
            costs = self._costs(_run_keys(digits))
            costs[digits == 0] = 0
            result[i:j] = np.add.reduceat(costs, np.cumsum(lengths + 1) - lengths - 1, axis=0, dtype=np.int64)
            i = j
        return result


def code_lengths(model: Model, texts: list[bytes]) -> np.ndarray:
    """(rows, langs) code lengths of whole texts in 1/UNIT bits."""
    return Coder(model).code_lengths(texts)


def _predictor(shared):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model | None = shared.value
        coder = Coder(model) if model is not None else None
        for batch in batches:
            texts = [t if t is not None and LETTER.search(t) else None for t in batch.column(1).to_pylist()]
            coded = [t.lower().encode() for t in texts if t is not None]
            langs, scores, rates = [UNDETERMINED] * len(texts), [0.0] * len(texts), [None] * len(texts)
            if coder is not None and coded:
                bits = coder.code_lengths(coded) / UNIT
                best = bits.argmin(1)
                gap = bits - bits[np.arange(len(bits)), best][:, None]
                share = 1 / np.exp2(-np.minimum(gap, 1000)).sum(1)
                rows = [k for k, t in enumerate(texts) if t is not None]
                for k, b, s, total, t in zip(rows, best.tolist(), share.tolist(), bits.min(1).tolist(), coded, strict=True):
                    langs[k], scores[k], rates[k] = model.langs[b], s, total / len(t)
            yield pa.RecordBatch.from_arrays([*batch.columns[:1], *batch.columns[2:], pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rates, pa.float64())], names=[*batch.schema.names[:1], *batch.schema.names[2:], "lang_pred", "score", "bits_per_byte"])

    return predict


def predict_language(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits_per_byte of every row.

    A null text or one without a letter is `und` with score 0; so is every text if there is
    no model (nothing labelled to learn from). score is the winner's share of the summed
    probabilities 2**-bits; a tie goes to the name that sorts first. bits_per_byte is the
    winner's code length (null for `und`). Rows that repeat are predicted each; other
    columns are ignored. A null id counts as not held out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), held_out(F.col(id_col)).alias("held_out"))
    return small_batches(rows).mapInArrow(_predictor(shared), "doc_id long, held_out boolean, lang_pred string, score double, bits_per_byte double").select("doc_id", "held_out", "lang_pred", "score", "bits_per_byte")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **bounds: int) -> DataFrame:
    """Learns from the rows that aren't held out, then predicts every row."""
    drawn = {k: v for k, v in bounds.items() if k in ("docs_per_lang", "max_doc_chars")}
    grown = {k: v for k, v in bounds.items() if k in ("max_nodes", "least_count")}
    return predict_language(docs, train(training_sample(docs, id_col, text_col, lang_col, **drawn), **grown), id_col, text_col)


def keep_identified(docs: DataFrame, model: Model | None, most_bits: float = 7.5) -> DataFrame:
    """The rows of docs, with all their columns, whose text is in some learned language.

    Rejected: `und` texts, and texts that the best language can't code in most_bits a byte,
    which is hardly better than raw bytes.
    """
    names = docs.columns
    text = names.index("text")
    kept = docs.schema

    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value) if shared.value is not None else None
        for batch in batches:
            texts = [t.lower().encode() if t is not None and LETTER.search(t) else None for t in batch.column(text).to_pylist()]
            coded = [t for t in texts if t is not None]
            good = iter((coder.code_lengths(coded).min(1) <= np.array([len(t) for t in coded]) * (most_bits * UNIT)).tolist() if coder is not None and coded else [False] * len(coded))
            yield batch.filter(pa.array([t is not None and next(good) for t in texts], pa.bool_()))

    return small_batches(docs).mapInArrow(keep, kept)
