"""Cross-tokenizer alignment: which ids of a byte-level tokenizer (A) stand for which ids of a piece tokenizer (B).

A encodes a blank and the text, B the text (it adds the blank itself).  Offsets in bytes at which tokens of both end cut
them into groups; in a group of p and q tokens p + q - 1 pairs overlap, and each is a link.  A pair of ids counts as many
links as the corpus has of it.

Fast path: ``identity`` maps each A id to the B id of the same bytes (-1 if none).  A group of such two tokens is counted
in one vector over A's vocabulary per task.  Only the pairs of all other groups are shuffled: once per slice of text and
pair, to be counted, and back to their slice with the count and whether it is the highest of its B id.

Neither tokenizer joins what a single blank between two other signs than white space parts, so texts are cut there into
units; a unit is tokenised and aligned once while it is remembered, and documents are gathered from units.

A text that is null or empty, or whose tokens of A or B don't spell the blank and the text, has no tokens: all its numbers
are 0 and its digest is ''.  Rows that repeat are documents each; an id may be null.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.session import stored

#: Characters of text in a slice, but for single longer texts.
SLICE_CHARS = 1 << 20
#: Characters of the units that a task remembers between slices.
KNOWN_CHARS = 2 << 20
#: Characters of units tokenised in one text.
_TEXT_CHARS = 1 << 15

_DOC = {n: "bigint" for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links")} | {"groups_sha256": "string"}
_PART = {"slice": "bigint", "kind": "int", **_DOC, "codes": "binary", "times": "binary", "a": "int", "b": "int", "n": "bigint", "code": "int"}
_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
RESULT = {n: "string" if n == "groups_sha256" else "bigint" for n in (*_DOC, "n_best", "count_sum")}


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers, the bytes of their ids, and the identity map."""

    def __init__(self, a_path: str, b_path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        to_byte = byte_level()
        vocabulary = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            known = all(c in to_byte for c in token)
            self.a_bytes[i] = bytes(to_byte[c] for c in token) if known else token.encode()
        self.b_bytes = [
            bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode("utf-8", "surrogatepass")
            for i, piece in ((i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))
        ]
        of_bytes: dict[bytes, int] = {}
        for i, spelt in enumerate(self.b_bytes):  # a whole piece goes before a byte
            if spelt not in of_bytes or self.b.is_byte(of_bytes[spelt]):
                of_bytes[spelt] = i
        self.identity = np.array([of_bytes.get(spelt, -1) for spelt in self.a_bytes], np.int64)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of A for a blank and the text, and of B for the text."""
        a = self.a.encode(" " + text, add_special_tokens=False).ids
        return np.array(a, np.int64), np.array(self.b.encode(text, num_threads=1), np.int64)


#: No token reaches over a single blank between two signs that are neither white space nor the sign B has for a blank.
_CUT = re.compile(r"(?<=[^\s\u2581]) (?=[^\s\u2581])")


def units(text: str) -> list[str]:
    """The text cut at blanks that no token reaches over."""
    return _CUT.split(text)


def _joinable(unit: str) -> bool:
    return not any(c.isspace() or c == "\u2581" for c in (unit[0], unit[-1]))


class Units:
    """Aligned units: numbers, groups as text, and links as codes (an A id for an identical pair, else beyond them)."""

    def __init__(self, tokenizers: Tokenizers):
        self.tokenizers, self.vocabulary, self.b_vocabulary = tokenizers, len(tokenizers.a_bytes), len(tokenizers.b_bytes)
        self.a_sizes, self.b_sizes = (np.fromiter(map(len, x), np.int64) for x in (tokenizers.a_bytes, tokenizers.b_bytes))
        self.identical = [f"{i}|{j}" for i, j in enumerate(tokenizers.identity.tolist())]
        self.clear()

    def clear(self) -> None:
        self.chars = 0
        self.number: dict[str, int] = {}
        self.texts: list[bytes] = []
        self.counts = [np.zeros((0, 5), np.int64)]  # of A, of B, groups, links, and whether the tokens spell the unit
        self.links = [np.zeros(0, np.int64)]

    def add(self, new: list[str]) -> None:
        text: list[str] = []
        chars = 0
        for unit in new:
            if not _joinable(unit):
                self._add([unit])
                continue
            if chars + len(unit) > _TEXT_CHARS and text:
                self._add(text)
                text, chars = [], 0
            text.append(unit)
            chars += len(unit)
        if text:
            self._add(text)

    def _add(self, some: list[str]) -> None:
        """Units that are tokenised in one text; one by one if that isn't spelt right."""
        joined = " ".join(some)
        a, b = self.tokenizers.encode(joined)
        spelt = b" " + joined.encode("utf-8", "surrogatepass")
        right = all(b"".join(map(x.__getitem__, ids.tolist())) == spelt for x, ids in ((self.tokenizers.a_bytes, a), (self.tokenizers.b_bytes, b)))
        if right:
            self._align(some, a, b)
        elif len(some) > 1:
            for unit in some:
                self._add([unit])
            return
        else:
            self.counts.append(np.zeros((1, 5), np.int64))
            self.texts.append(b"")
        self.number.update(zip(some, range(len(self.number), len(self.number) + len(some))))
        self.chars += len(joined)

    def _align(self, some: list[str], a: np.ndarray, b: np.ndarray) -> None:
        ends_a, ends_b = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        ends = np.intersect1d(ends_a, ends_b, assume_unique=True)  # of groups
        last_a, last_b = np.searchsorted(ends_a, ends) + 1, np.searchsorted(ends_b, ends) + 1
        first_a, first_b = np.r_[0, last_a[:-1]], np.r_[0, last_b[:-1]]
        same = (last_a - first_a == 1) & (last_b - first_b == 1) & (self.tokenizers.identity[a[first_a]] == b[first_b])
        # Between two ends of either kind lies one pair of tokens that overlap.
        steps = np.union1d(ends_a, ends_b)
        pair_a, pair_b = a[np.searchsorted(ends_a, steps)], b[np.searchsorted(ends_b, steps)]
        self.links.append(np.where(same[np.searchsorted(ends, steps)], pair_a, self.vocabulary + pair_a * self.b_vocabulary + pair_b))

        sizes = np.fromiter((len(u.encode("utf-8", "surrogatepass")) + 1 for u in some), np.int64, len(some))
        unit_ends = np.cumsum(sizes)
        counts = [np.searchsorted(x, unit_ends, side="right") for x in (ends_a, ends_b, ends, steps)]
        self.counts.append(np.stack([*(np.diff(c, prepend=0) for c in counts), np.ones(len(some), np.int64)], axis=1))
        name_a, name_b, identical = list(map(str, a.tolist())), list(map(str, b.tolist())), self.identical
        texts = [
            identical[i] if one else ",".join(name_a[i0:i1]) + "|" + ",".join(name_b[j0:j1])
            for one, i, i0, i1, j0, j1 in zip(*(x.tolist() for x in (same, a[first_a], first_a, last_a, first_b, last_b)))
        ]
        at = 0
        for end in counts[2].tolist():
            self.texts.append(";".join(texts[at:end]).encode())
            at = end


def _batch(rows: int, **columns) -> pa.RecordBatch:
    kinds = {name: _ARROW[kind] for name, kind in _PART.items()}
    made = [pa.array(columns[name], kind) if name in columns else pa.nulls(rows, kind) for name, kind in kinds.items()]
    return pa.RecordBatch.from_arrays(made, names=list(kinds))


def _slice_rows(known: Units, ids: list, texts: list[str | None], number: int, same: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of irregular pairs (kind 0) and of documents (kind 1) of one slice; identical pairs are added to ``same``."""
    cut = [units(t) if t else [] for t in texts]
    if known.chars > KNOWN_CHARS:
        known.clear()
    known.add(list({u for parts in cut for u in parts} - known.number.keys()))
    unit = np.fromiter(itertools.chain.from_iterable(map(known.number.__getitem__, parts) for parts in cut), np.int64)
    ends = np.cumsum([len(parts) for parts in cut])
    starts = np.r_[0, ends[:-1]]
    counts, links = np.concatenate(known.counts), np.concatenate(known.links)
    sums = np.vstack([np.zeros((1, 5), np.int64), np.cumsum(counts[unit], axis=0)])
    sums = sums[ends] - sums[starts]
    good = (sums[:, 4] == ends - starts) & (ends > starts)
    sums[~good] = 0

    doc = np.repeat(np.arange(len(cut)), ends - starts)
    whole = good[doc]  # units of texts that have tokens
    size, doc = counts[unit[whole], 3], doc[whole]
    first = (np.cumsum(counts[:, 3]) - counts[:, 3])[unit[whole]]
    codes = links[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
    span = int(codes.max()) + 1 if len(codes) else 1
    both, times = np.unique(np.repeat(doc, size) * span + codes, return_counts=True)
    doc, codes = both // span, both % span

    irregular = codes >= known.vocabulary
    np.add.at(same, codes[~irregular], times[~irregular])
    pairs, local = np.unique(codes[irregular], return_inverse=True)
    total = np.zeros(len(pairs), np.int64)
    np.add.at(total, local, times[irregular])
    codes[irregular] = known.vocabulary + local
    a, b = np.divmod(pairs - known.vocabulary, known.b_vocabulary)

    edges = np.searchsorted(doc, np.arange(len(cut) + 1)).tolist()
    codes, times = codes.astype(np.int32), times.astype(np.int32)
    digests = [
        hashlib.sha256(b";".join(map(known.texts.__getitem__, unit[s:e].tolist()))).hexdigest() if g else ""
        for s, e, g in zip(starts.tolist(), ends.tolist(), good.tolist())
    ]
    n, m = len(pairs), len(cut)
    yield _batch(n, slice=np.full(n, number), kind=np.zeros(n, np.int64), a=a, b=b, n=total, code=np.arange(n))
    own = dict(zip(("n_a", "n_b", "n_groups", "n_links"), sums.T))
    packed = {name: [x[s:e].tobytes() for s, e in zip(edges, edges[1:])] for name, x in (("codes", codes), ("times", times))}
    yield _batch(m, slice=np.full(m, number), kind=np.ones(m, np.int64), doc_id=ids, groups_sha256=digests, **own, **packed)


def _parts(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Rows of all slices, see ``_slice_rows``; a task's identical pairs come last, in rows of kind 2."""
    slice_chars = SLICE_CHARS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known = Units(Tokenizers(a_path, b_path))
        number = TaskContext.get().partitionId() << 32
        same = np.zeros(known.vocabulary, np.int64)
        for batch in batches:
            texts, ids, at = batch.column("text"), batch.column("doc_id"), 0
            sizes = np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + slice_chars, side="right")))
                yield from _slice_rows(known, ids[at:to].to_pylist(), texts[at:to].to_pylist(), number, same)
                number, at = number + 1, to
        used = np.flatnonzero(same)
        yield _batch(len(used), kind=np.full(len(used), 2), a=used, b=known.tokenizers.identity[used], n=same[used])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, ", ".join(f"{name} {kind}" for name, kind in _PART.items()))


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    spark = docs.sparkSession
    parts = stored(_parts(docs, a_path, b_path), "aligned")
    counts = stored(parts.where("kind <> 1").groupBy("a", "b").agg(F.sum("n").alias("total")), "pair-counts")
    most = counts.groupBy("b").agg(F.max("total").alias("most"))  # at most a row per B id
    counts = counts.join(F.broadcast(most), "b").select("a", "b", "total", (F.col("total") == F.col("most")).alias("best"))

    identity = Tokenizers(a_path, b_path).identity
    same = spark.createDataFrame(pa.table({"a": pa.array(np.flatnonzero(identity >= 0), pa.int32()), "b": pa.array(identity[identity >= 0], pa.int32())}))
    rows = counts.join(F.broadcast(same), ["a", "b"]).toArrow()  # at most a row per A id
    totals, bests = np.zeros(len(identity), np.int64), np.zeros(len(identity), bool)
    totals[rows.column("a").to_numpy()] = rows.column("total").to_numpy()
    bests[rows.column("a").to_numpy()] = rows.column("best").to_numpy()

    answers = parts.where("kind = 0").select("slice", "kind", "a", "b", "code").join(counts, ["a", "b"])
    answers = answers.select("slice", "kind", "code", "total", "best")
    own = parts.where("kind = 1").select("slice", "kind", *_DOC, "codes", "times")
    both = answers.unionByName(own, allowMissingColumns=True).repartition("slice").sortWithinPartitions("slice", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, found = None, []
        table = totals, bests
        for batch in batches:
            slices, kinds = (batch.column(n).to_numpy() for n in ("slice", "kind"))
            edges = np.flatnonzero(np.r_[True, (np.diff(slices) != 0) | (np.diff(kinds) != 0)]) if len(slices) else []
            for a, b in zip(edges, [*edges[1:], len(slices)]):
                part = batch.slice(a, b - a)
                if slices[a] != at:
                    at, found, table = slices[a], [], None
                if kinds[a] == 0:
                    found.append([part.column(n).to_numpy(zero_copy_only=False) for n in ("code", "total", "best")])
                    continue
                if table is None:
                    table = totals, bests
                    if found:
                        code, total, best = (np.concatenate(x) for x in zip(*found))
                        order = np.argsort(code)  # all codes from 0 on
                        table = np.r_[totals, total[order]], np.r_[bests, best[order].astype(bool)]
                sums = []
                for codes, times in zip(part.column("codes").to_pylist(), part.column("times").to_pylist()):
                    codes, times = np.frombuffer(codes, np.int32), np.frombuffer(times, np.int32)
                    sums.append((int(times[table[1][codes]].sum()), int((table[0][codes] * times).sum())))
                columns = {n: part.column(n) for n in _DOC}
                columns |= {n: pa.array([s[i] for s in sums], pa.int64()) for i, n in enumerate(("n_best", "count_sum"))}
                yield pa.RecordBatch.from_pydict({n: columns[n] for n in RESULT})

    return both.mapInArrow(run, ", ".join(f"{name} {kind}" for name, kind in RESULT.items()))
