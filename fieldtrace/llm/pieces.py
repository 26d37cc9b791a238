"""SentencePiece encoding and decoding on a relational lattice.

Texts are cut into units that no piece crosses (runs of letters or of other characters, each with the spaces before it), so
only distinct units need a lattice. Each unit's substrings of bounded length are exploded and equi-joined to the piece
table; the edges are grouped by unit, where they already lie, and folded by a higher-order aggregate:

* ``fold_viterbi`` for unigram models: the path with the largest sum of scores.
* ``fold_in_order`` for BPE models: the library joins neighbours by best score, which a sum over a path cannot express; the fold
  goes through the edges from best to worst and applies those whose two halves are both present. Where an edge comes to fit only
  after its turn, ``fold_merges`` applies the best fitting edge until none is left. Units over LONG characters, where a fold over
  a row would take quadratic time, do the same with a heap.

The ids of the units return to the texts by a sorted table of unit hashes. Each executor gets it as files, up to ``most_units`` units (its
size is counted first); beyond, the most frequent ones are in it and the units left over reach their texts by shuffled joins.
Ids are those of the library for the same model file.

Defined cases: a null text has null ids and stays null; an empty text has no ids; characters without a piece become byte pieces; a literal
U+2581 decodes to a space, as in the library; repeated rows get equal results; an empty table gives an empty result;
extra columns are passed on, and those named like an output are replaced.
"""

from __future__ import annotations

import atexit
import hashlib
import heapq
import itertools
import re
import shutil
import tempfile
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from fieldtrace.llm.common import let, query, row_key, stage
from fieldtrace.session import configure

SPACE = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
LONG, MOST_UNITS = 48, 4_000_000
#: Bytes of texts that are cut into units together.
TOGETHER = 4_000_000
#: Units whose lattices one task groups, so few that it need not spill.
UNITS = 15_000


@dataclass(frozen=True)
class Model:
    """The piece table of a model file: (piece, id, score) of ordinary pieces, ids of the bytes, and how it is folded."""

    pieces: tuple[tuple[str, int, float], ...]
    bytes_: tuple[int, ...]
    bpe: bool
    unit: str
    longest: int


def _unit_pattern(pieces: list[str]) -> str:
    """A pattern for units that no piece crosses: letters and others apart if the pieces allow it, else up to the next space."""
    odd = "".join(sorted({c for p in pieces for c in p if re.fullmatch(r"[^\W\d_]", c) and not c.isalpha()}))
    letter = rf"[^\W\d_{re.escape(odd)}]"
    other = rf"[\W\d_{re.escape(odd)}]"
    for core in (rf"{SPACE}*{letter}+|{SPACE}*(?:(?!{SPACE}){other})+", rf"{SPACE}*[^{SPACE}]+"):
        whole = re.compile(rf"(?:{core}|{SPACE}+)\Z")
        if all(whole.match(p) for p in pieces):
            return rf"{core}|{SPACE}+"
    raise ValueError("a piece goes on after a space; such a model cannot be cut into units")


def load(path: str = MODEL, bpe: bool = True) -> Model:
    """The piece table of a model file. ``bpe``: the model's type, which the library does not tell."""
    import sentencepiece
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    own, byte_ids = [], {}
    for i in range(lib.get_piece_size()):
        piece = lib.id_to_piece(i)
        if lib.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
        elif not (lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i)):
            own.append((piece, i, lib.get_score(i)))
    names = [p for p, _, _ in own]
    return Model(tuple(own), tuple(byte_ids[b] for b in range(256)), bpe, _unit_pattern(names), max(map(len, names)))


# ``units``, ``words`` and ``cut`` are the plain form of ``Cutter``, text by text or word by word; the tests hold it to them.
def units(text: str, pattern: re.Pattern) -> list[str]:
    return pattern.findall(SPACE + text.replace(" ", SPACE)) if text else []


def words(text: str) -> list[str]:
    """The text cut before each run of spaces, without the first of them (as if a space came before the text): no unit crosses such a cut."""
    if "  " in text or SPACE in text or text[:1] == " ":
        return [w[1:] for w in re.findall(" +[^ ]*", " " + text.replace(SPACE, " "))]
    return text.split(" ")


def cut(parts: list[str], pattern: re.Pattern) -> tuple[list[str], np.ndarray]:
    """(the units of distinct words one after the other, the place of the word that each is from), in one pass over all words."""
    # spaces at the end of a word would run on into the next one's, so such words come last, each by itself
    closed = np.fromiter(map(bool, parts), bool, len(parts)) & ~np.fromiter(map(str.endswith, parts, itertools.repeat(" ")), bool, len(parts))
    inner = parts if closed.all() else list(itertools.compress(parts, closed))
    flat = pattern.findall(SPACE + SPACE.join(inner).replace(" ", SPACE)) if inner else []
    # a word's first unit, and no other, begins with a space
    first = np.fromiter(map(str.startswith, flat, itertools.repeat(SPACE)), bool, len(flat))
    owner = np.flatnonzero(closed)[np.cumsum(first) - 1] if inner else np.zeros(0, np.int64)
    for i in np.flatnonzero(~closed).tolist():
        own = pattern.findall(SPACE + parts[i].replace(" ", SPACE))
        flat += own
        owner = np.append(owner, np.full(len(own), i))
    return flat, owner


class Cutter:
    """Cuts texts into the units of a pattern, all texts of an array at once. A unit ends before a space that follows no other, and
    between characters that no unit holds side by side; these are of two kinds, or of one if units go up to the next space."""

    def __init__(self, pattern: re.Pattern):
        self.pattern = pattern
        # kind by code point: 0 a space, 1 goes with "a", 2 does not, 3 not asked for yet
        self.kind = np.full(0x110000, 3, np.uint8)
        self.kind[:128] = [self._kind(c) for c in range(128)]
        self.kind[32] = 0

    def _kind(self, point: int) -> int:
        return 1 if self.pattern.fullmatch("a" + chr(point)) else 2

    def _kinds(self, data: np.ndarray) -> np.ndarray:
        """The kind of the character that each byte of UTF-8 belongs to."""
        kinds = self.kind[data]
        lead = np.flatnonzero(data >= 0xC0)
        for low, high, size in ((0xC0, 0xE0, 2), (0xE0, 0xF0, 3), (0xF0, 0x100, 4)):
            at = lead[(data[lead] >= low) & (data[lead] < high)]
            point = data[at].astype(np.int32) & (0xFF >> (size + 1))
            for k in range(1, size):
                point = point << 6 | data[at + k] & 0x3F
            kind = self.kind[point]
            if (kind == 3).any():
                new = np.unique(point[kind == 3])
                self.kind[new] = [self._kind(c) for c in new.tolist()]
                kind = self.kind[point]
            for k in range(size):
                kinds[at + k] = kind
        return kinds

    def cut(self, texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
        """(the units of the texts one after the other, how many each text has)."""
        some = pc.greater(pc.binary_length(texts).fill_null(0), 0)
        counts = np.zeros(len(texts), np.int64)
        kept = texts.filter(some)
        if not len(kept):
            return pa.array([], pa.string()).dictionary_encode(), counts
        spaced = pc.replace_substring(pc.binary_join_element_wise("", kept, " "), SPACE, " ")
        ends = np.frombuffer(spaced.buffers()[1], np.int32)[spaced.offset:spaced.offset + len(spaced) + 1]
        data = np.frombuffer(spaced.buffers()[2], np.uint8)[:ends[-1]]
        kinds = self._kinds(data)
        first = np.empty(len(data), bool)
        np.not_equal(kinds[1:], kinds[:-1], out=first[1:])
        first[1:] &= kinds[:-1] != 0
        first[ends[:-1]] = True
        starts = np.flatnonzero(first[ends[0]:]) + ends[0]
        counts[some.to_numpy(zero_copy_only=False)] = np.diff(np.searchsorted(starts, ends))
        at = np.append(starts, ends[-1]).astype(np.int32)
        coded = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(at), spaced.buffers()[2]]).dictionary_encode()
        return pa.DictionaryArray.from_arrays(coded.indices, pc.replace_substring(coded.dictionary, " ", SPACE)), counts


def _distinct(batches, unit: str):
    cutter, held = Cutter(re.compile(unit)), []

    def flush():
        coded = cutter.cut(pa.concat_arrays(held))[0]
        held.clear()
        return pa.RecordBatch.from_arrays([coded.dictionary, pa.array(np.bincount(coded.indices, minlength=len(coded.dictionary)).astype(np.int64))], names=["unit", "n"])

    for batch in batches:
        held.append(batch.column("text").cast(pa.string()))
        if sum(t.nbytes for t in held) > TOGETHER:
            yield flush()
    if held:
        yield flush()


PIECE = "struct<start: int, next: int, id: int>"


def _fits(cuts: Column, e: Column) -> Column:
    """Whether both halves of an edge are present: it starts and ends at a cut, with exactly one cut between."""
    return (cuts.bitwiseAND(e["ends"]) == e["ends"]) & (F.bit_count(cuts.bitwiseAND(e["inner"])) == 1)


def fold_merges(edges: Column, n: Column) -> Column:
    """The cuts between the final pieces of a unit of n characters, a bit for each.

    ``edges`` are in order of preference; ``ends`` and ``inner`` are the bits of the cuts at an edge's ends and between them.
    """
    def step(cuts, _):
        best = F.get(F.filter(edges, lambda e: _fits(cuts, e)), 0)
        return cuts.bitwiseAND(F.bitwise_not(F.coalesce(best["inner"], F.lit(0).cast("long"))))
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(-1).cast("long"), step)


def fold_in_order(edges: Column, n: Column) -> Column:
    """The result of ``fold_merges`` in one pass over the edges.

    In order of preference an edge's halves are mostly decided before the edge is. Only a late piece has a half that it precedes;
    such edges wait, and a unit where one of them comes to fit after its turn is folded step by step instead.
    """
    def step(s, e):
        cuts = s["cuts"]

        def apply(new):
            woken = F.coalesce(F.exists(s["waiting"], lambda w: _fits(new, w)), F.lit(False))
            return F.struct(new.alias("cuts"), s["waiting"].alias("waiting"), (s["again"] | woken).alias("again"))
        wait = F.struct(cuts.alias("cuts"), F.array_append(s["waiting"], F.struct(e["ends"].alias("ends"), e["inner"].alias("inner"))).alias("waiting"),
                        s["again"].alias("again"))
        return (F.when(_fits(cuts, e), let(cuts.bitwiseAND(F.bitwise_not(e["inner"])), apply))
                .when(e["late"] & (cuts.bitwiseAND(e["ends"]) == e["ends"]), wait).otherwise(s))

    first = F.struct(F.lit(-1).cast("long").alias("cuts"), F.array().cast("array<struct<ends: bigint, inner: bigint>>").alias("waiting"), F.lit(False).alias("again"))
    return let(F.aggregate(edges, first, step), lambda s: F.when(s["again"], fold_merges(edges, n)).otherwise(s["cuts"]))


def between_cuts(edges: Column, cuts: Column) -> Column:
    """The pieces that lie between neighbouring cuts, in order."""
    whole = F.filter(edges, lambda e: (cuts.bitwiseAND(e["ends"]) == e["ends"]) & (cuts.bitwiseAND(e["inner"]) == 0))
    return F.array_sort(F.transform(whole, lambda e: F.struct(e["start"].alias("start"), (e["start"] + e["length"]).alias("next"), e["id"].alias("id")).cast(PIECE)))


def _late(pieces) -> list[bool]:
    """Which pieces can be joined of halves of which one is no better than the whole."""
    rank = {p: -s for p, _, s in pieces}

    def when(part):
        return float("-inf") if len(part) == 1 else rank.get(part)

    def is_late(p):
        halves = [(when(p[:i]), when(p[i:])) for i in range(1, len(p))]
        return any(a is not None and b is not None and max(a, b) >= rank[p] for a, b in halves)
    return [is_late(p) for p, _, _ in pieces]


def fold_viterbi(chars: Column, edges: Column, n: Column, unknown: float = 1e6) -> Column:
    """The pieces of the path with the least sum of ranks (negative scores); a character without a piece costs ``unknown``."""
    state = f"struct<rank: double, pieces: array<{PIECE}>>"
    first = F.array(F.struct(F.lit(0.0).alias("rank"), F.array().cast(f"array<{PIECE}>").alias("pieces")).cast(state))

    def step(best, end):
        def onto(start, rank, piece):
            return F.struct((F.get(best, start)["rank"] + rank).alias("rank"), F.array_append(
                F.get(best, start)["pieces"], F.struct(start.alias("start"), end.alias("next"), piece.alias("id")).cast(PIECE)).alias("pieces")).cast(state)
        known = F.transform(F.filter(edges, lambda e: e["end"] == end), lambda e: onto(e["start"], e["rank"], e["id"]))
        alone = let(F.get(chars, end - 1), lambda c: onto(c["start"], F.coalesce(c["rank"], F.lit(unknown)), c["id"]))
        return F.array_append(best, F.array_min(F.array_append(known, alone)))

    return F.get(F.aggregate(F.sequence(F.lit(1), n), first, step), n)["pieces"]


def _heap_merges(rows: list[dict]) -> list[dict]:
    """The pieces that ``fold_merges`` leaves, for long units."""
    chars = sorted((e for e in rows if e["length"] == 1), key=lambda e: e["start"])
    known = {(e["start"], e["start"] + e["length"]): (e["rank"], e["id"]) for e in rows if e["length"] > 1}
    after = {c["start"]: c["start"] + 1 for c in chars}
    before = {b: a for a, b in after.items()}
    ids = {c["start"]: c["id"] for c in chars}
    heap: list[tuple[float, int, int, int]] = []

    def offer(start):
        mid = after.get(start)
        end = after.get(mid) if mid is not None else None
        if end is not None and (start, end) in known:
            heapq.heappush(heap, (known[start, end][0], start, mid, end))

    for start in list(after):
        offer(start)
    while heap:
        _, start, mid, end = heapq.heappop(heap)
        if after.get(start) != mid or after.get(mid) != end:
            continue
        after[start], before[end], ids[start] = end, start, known[start, end][1]
        del after[mid]
        offer(start)
        if start in before:
            offer(before[start])
    return [{"start": a, "next": after[a], "id": ids[a]} for a in sorted(after)]


PIECES_TYPE = ArrayType(StructType([StructField(c, IntegerType()) for c in ("start", "next", "id")]))


@F.arrow_udf(PIECES_TYPE)
def _long_merges(edges: pa.Array) -> pa.Array:
    return pa.array([_heap_merges(e) for e in edges.to_pylist()], pa.list_(pa.struct([(c, pa.int32()) for c in ("start", "next", "id")])))


def lattice(found: DataFrame, model: Model) -> DataFrame:
    """(unit, n, ids) for the distinct units (unit, n)."""
    spark = found.sparkSession
    # the piece table is bounded by the model file
    table = F.broadcast(spark.createDataFrame(pa.table({"piece": [p for p, _, _ in model.pieces], "id": pa.array([i for _, i, _ in model.pieces], pa.int32()),
                                                        "rank": [-s for _, _, s in model.pieces], "late": _late(model.pieces)})))
    size = F.length("unit")
    spans = (found.select("unit", "n", F.explode(F.sequence(F.lit(0), size - 1)).alias("start"))
             .select("unit", "n", "start", F.explode(F.sequence(F.lit(1), F.least(size - F.col("start"), F.lit(model.longest)))).alias("length"))
             .select("unit", "n", "start", "length", F.substring("unit", F.col("start") + 1, F.col("length")).alias("piece")))
    def shifted(bits: int, by: Column) -> Column:
        return F.call_function("shiftleft", F.lit(bits).cast("long"), by)
    start, end = F.col("start"), F.col("start") + F.col("length")
    edge = F.struct("rank", "start", "length", "id", shifted(1, start).bitwiseOR(shifted(1, end)).alias("ends"),
                    shifted(-1, start + 1).bitwiseAND(F.bitwise_not(shifted(-1, end))).alias("inner"), "late")
    n = F.length("unit")
    grouped = (spans.join(table, "piece", "left").where("id is not null or length = 1")
               .groupBy("unit").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(edge)).alias("edges")))
    if model.bpe:
        short = grouped.where(n <= LONG).withColumn("pieces", let(fold_in_order(F.col("edges"), n), lambda cuts: between_cuts(F.col("edges"), cuts)))
        long = grouped.where(n > LONG).withColumn("pieces", _long_merges("edges"))
        folded = short.unionByName(long)
    else:
        chars = F.array_sort(F.transform(F.filter("edges", lambda e: e["length"] == 1), lambda e: F.struct(e["start"].alias("start"), e["rank"].alias("rank"), e["id"].alias("id"))))
        longer = F.transform(F.filter("edges", lambda e: e["length"] > 1),
                             lambda e: F.struct(e["rank"].alias("rank"), e["start"].alias("start"), (e["start"] + e["length"]).alias("end"), e["id"].alias("id")))
        folded = grouped.withColumn("chars", chars).withColumn("longer", longer).withColumn("pieces", fold_viterbi(F.col("chars"), F.col("longer"), n))
    spelled = F.array(*[F.lit(i) for i in model.bytes_])

    def ids_of(p):
        code = F.hex(F.encode(F.substring("unit", p["start"] + 1, p["next"] - p["start"]), "UTF-8"))
        raw = F.transform(F.sequence(F.lit(0), (F.length(code) / 2 - 1).cast("int")), lambda k: F.get(
            spelled, F.conv(F.substring(code, (k * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")))
        return F.when(p["id"].isNotNull(), F.array(p["id"])).otherwise(raw)

    spelt = F.exists("pieces", lambda p: p["id"].isNull())
    return folded.select("unit", "n", F.when(spelt, F.flatten(F.transform("pieces", ids_of))).otherwise(F.transform("pieces", lambda p: p["id"])).alias("ids"))


def _key(unit: str) -> int:
    return xxhash.xxh3_64_intdigest(unit.encode("utf-8", "surrogatepass"))


def _keys(units: pa.Array) -> np.ndarray:
    # a digest is its number, the highest byte first
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, units.cast(pa.binary()).to_numpy(zero_copy_only=False))), ">u8").astype(np.uint64)


def _pack(batches, width):
    """Hashes, lengths and ids (of type ``width``) of units, packed for the table that tasks look units up in."""
    for batch in batches:
        ids = batch.column("ids")
        key = _keys(batch.column("unit"))
        n = np.diff(np.asarray(ids.offsets)).astype(np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (key, n, np.asarray(ids.flatten()).astype(width))], names=["key", "n", "ids"])


def _spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places start[i], start[i] + 1, ... of n[i] entries each, one after the other."""
    ends = np.cumsum(n)
    return np.repeat(start - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)


@dataclass(frozen=True)
class Lookup:
    """Unit -> ids for the units of the shared table: NumPy files that Spark hands to each executor once. The workers of an
    executor map them, so that they hold one table and not one each."""

    name: str

    @classmethod
    def share(cls, spark: SparkSession, rows: list, width) -> Lookup:
        # one array after the other, and no copy longer than needed: this runs in the driver
        key, n, ids = (np.frombuffer(b"".join([r[i] for r in rows]), t) for i, t in enumerate((np.uint64, np.uint32, width)))
        rows.clear()
        order = np.argsort(key, kind="stable").astype(np.uint32)
        start = np.cumsum(n, dtype=np.int64) - n
        if len(ids) < 1 << 32:
            start = start.astype(np.uint32)
        if n.max(initial=0) < 1 << 8:
            n = n.astype(np.uint8)
        name = f"units-{uuid.uuid4().hex}"
        folder = tempfile.mkdtemp(prefix="fieldtrace-units-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        for part, values, by in (("key", key, order), ("start", start, order), ("n", n, order), ("ids", ids, slice(None))):
            np.save(f"{folder}/{name}-{part}.npy", values[by])
            spark.sparkContext.addFile(f"{folder}/{name}-{part}.npy")
        return cls(name)

    def open(self) -> Reader:
        return Reader(*(np.load(SparkFiles.get(f"{self.name}-{part}.npy"), mmap_mode="r") for part in ("key", "start", "n", "ids")))


class Reader:
    """A worker's view of the shared table."""

    def __init__(self, key: np.ndarray, start: np.ndarray, n: np.ndarray, ids: np.ndarray):
        self.key, self.start, self.n, self.ids = key, start, n, ids
        self.cutter: Cutter | None = None

    def _find(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(whether each unit is in the table, how many ids it has, the ids one after the other)."""
        key = _keys(units)
        found, start, n = np.zeros(len(key), bool), np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
        if len(self.key):
            # neighbours in the table are looked up one after the other
            order = np.argsort(key)
            place = np.empty(len(key), np.int64)
            place[order] = np.minimum(np.searchsorted(self.key, key[order]), len(self.key) - 1)
            found = self.key[place] == key
            start[found], n[found] = self.start[place[found]], self.n[place[found]]
        return found, n, self.ids[_spread(start, n)].astype(np.int32)

    def encode(self, texts: pa.Array | list[str], pattern: re.Pattern, more: list[dict[str, list[int]]]) -> tuple[np.ndarray, np.ndarray, list[set[str]]]:
        """(the ids of the texts, how many each has, the units of each that are neither in the table nor in ``more``)."""
        if self.cutter is None or self.cutter.pattern != pattern:
            self.cutter = Cutter(pattern)
        coded, counts = self.cutter.cut(texts.cast(pa.string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        found, unit_n, unit_ids = self._find(coded.dictionary)
        code = np.asarray(coded.indices)
        n = unit_n[code]
        ids = unit_ids[_spread((np.cumsum(unit_n) - unit_n)[code], n)]
        ends = np.concatenate([[0], np.cumsum(n)])
        lengths = np.diff(ends[np.concatenate([[0], np.cumsum(counts)])])
        missing: list[set[str]] = [set() for _ in range(len(texts))]
        if not found.all():
            ids = self._spell_out(coded, np.flatnonzero(~found[code]), np.repeat(np.arange(len(texts)), counts), ends, ids, lengths, more, missing)
        return ids, lengths, missing

    @staticmethod
    def _spell_out(coded, places, owner, ends, ids, lengths, more, missing) -> np.ndarray:
        """The ids, and in ``lengths`` how many, where the units at some places are not in the table."""
        out, upto = [], 0
        for p, i, unit in zip(places.tolist(), owner[places].tolist(), coded.take(pa.array(places)).to_pylist()):
            if unit not in more[i]:
                missing[i].add(unit)
                continue
            out += [ids[upto:ends[p]], np.array(more[i][unit], np.int32)]
            upto = ends[p]
            lengths[i] += len(out[-1])
        return np.concatenate([*out, ids[upto:]])


def _runs(texts: pa.Array):
    """(start, end) of runs of texts of about TOGETHER bytes."""
    start, held = 0, 0
    for i, size in enumerate(pc.binary_length(texts).fill_null(0).to_pylist()):
        held += size
        if held > TOGETHER:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _missing(batches, shared: Lookup, unit: str):
    pattern, reader = re.compile(unit), shared.open()
    for batch in batches:
        keys, texts = batch.column("rk").to_pylist(), batch.column("text")
        for a, b in _runs(texts):
            rk, out = [], []
            for key, missing in zip(keys[a:b], reader.encode(texts[a:b], pattern, [{}] * (b - a))[2]):
                rk += [key] * len(missing)
                out += missing
            yield pa.RecordBatch.from_arrays([pa.array(rk, pa.int64()), pa.array(out, pa.string())], names=["rk", "unit"])


def encode(docs: DataFrame, model: Model, text_col: str = "text", most_units: int = MOST_UNITS) -> DataFrame:
    """``docs`` with ids, the piece ids of each whole text."""
    spark = configure(docs.sparkSession)
    pattern = model.unit
    distinct = docs.select(F.col(text_col).alias("text")).mapInArrow(lambda b: _distinct(b, pattern), "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))
    # a unit's substrings stay with it, so grouping its edges needs no second exchange
    distinct = stage(distinct, "distinct")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), distinct.count() // UNITS)
    table = stage(lattice(distinct.repartition(parts, "unit"), model), "units")
    frequent, whole = table, table.count() <= most_units
    if not whole:
        frequent = table.orderBy(F.desc("n"), "unit").limit(most_units)
    width = np.uint16 if max(i for i in (*(i for _, i, _ in model.pieces), *model.bytes_)) < 1 << 16 else np.uint32
    packed = frequent.select("unit", "ids").mapInArrow(lambda b: _pack(b, width), "key binary, n binary, ids binary")
    shared = Lookup.share(spark, packed.collect(), width)  # most_units at most
    keyed, more = docs, F.lit(None).cast("array<struct<unit: string, ids: array<int>>>")
    if not whole:
        keyed = docs.withColumn("__rk", row_key(F.col(text_col)))
        rare = (keyed.select(F.col("__rk").alias("rk"), F.col(text_col).alias("text")).mapInArrow(lambda b: _missing(b, shared, pattern), "rk long, unit string")
                .distinct().join(table.select("unit", "ids"), "unit").groupBy(F.col("rk").alias("__rk")).agg(F.collect_list(F.struct("unit", "ids")).alias("__more")))
        keyed, more = keyed.join(rare, "__rk", "left"), F.col("__more")
    opened: list[Reader] = []

    @F.arrow_udf(ArrayType(IntegerType()))
    def to_ids(text: pa.Array, extra: pa.Array) -> pa.Array:
        if not opened:
            opened.append(shared.open())
        compiled, out, lengths = re.compile(pattern), [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
        for a, b in _runs(text):
            units_of = [{x["unit"]: x["ids"] for x in e or ()} for e in extra[a:b].to_pylist()]
            ids, n, missing = opened[0].encode(text[a:b], compiled, units_of)
            if lacking := set().union(*missing):
                raise ValueError(f"no ids for {sorted(lacking)[:3]}")
            out.append(ids)
            lengths.append(n)
        ends = np.cumsum(np.concatenate(lengths)).astype(np.int32)
        offsets = pa.array(ends)
        if text.null_count:
            offsets = pa.array(ends, mask=np.append(text.is_null().to_numpy(zero_copy_only=False), False))
        return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(out)))

    return keyed.withColumn("ids", to_ids(F.col(text_col), more)).drop("__rk", "__more")


def _rows(lists: pa.Array):
    """The rows of a list array as NumPy slices."""
    ends, flat, known = np.asarray(lists.offsets), lists.values.to_numpy(), lists.is_valid().to_pylist()
    return (flat[a:b] if ok else None for a, b, ok in zip(ends, ends[1:], known))


def _spellings(model: Model) -> pa.Array:
    """The bytes of each piece by its id; null where there is none."""
    known = {i: p.replace(SPACE, " ").encode("utf-8", "surrogatepass") for p, i, _ in model.pieces} | {i: bytes([b]) for b, i in enumerate(model.bytes_)}
    return pa.array([known.get(i) for i in range(max(known) + 1)], pa.binary())


def _texts(lists: pa.Array, spelt: pa.Array) -> pa.Array:
    """The texts of lists of ids: the bytes of all their pieces are one buffer, which the lists' ends cut into texts."""
    ends = np.asarray(lists.offsets)
    parts = spelt.take(lists.values.slice(ends[0], ends[-1] - ends[0]))
    if parts.null_count:
        raise KeyError("an id without a piece")
    at, data = np.zeros(len(ends), np.int32), np.zeros(0, np.uint8)
    if len(parts):
        at, data = np.frombuffer(parts.buffers()[1], np.int32)[ends - ends[0]], np.frombuffer(parts.buffers()[2], np.uint8)
    # the first space is the one that every text is given before it is cut
    full = np.diff(at) > 0
    rest = np.ones(len(data), bool)
    rest[at[:-1][full]] = False
    at = at - np.concatenate([[0], np.cumsum(full)])
    whole = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data[rest])])
    if lists.null_count:
        whole = pc.if_else(lists.is_valid(), whole, pa.scalar(None, pa.binary()))
    try:
        return whole.cast(pa.string())
    except pa.ArrowInvalid:  # ids that spell no valid UTF-8
        return pa.array([None if x is None else x.decode("utf-8", "replace") for x in whole.to_pylist()], pa.string())


def decode(encoded: DataFrame, model: Model, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its piece ids."""
    spelt = _spellings(model)

    @F.arrow_udf(StringType())
    def to_text(ids: pa.Array) -> pa.Array:
        return _texts(ids, spelt)

    return encoded.withColumn(out_col, to_text(F.col(ids_col)))


DIGEST = StructType([StructField("n_pieces", LongType()), StructField("ids_sha256", StringType())])


@F.arrow_udf(DIGEST)
def _digest(ids: pa.Array) -> pa.Array:
    rows = [np.zeros(0, np.int32) if x is None else x for x in _rows(ids)]
    return pa.StructArray.from_arrays([pa.array([len(r) for r in rows], pa.int64()), pa.array([hashlib.sha256(r.astype("<i4").tobytes()).hexdigest() for r in rows])],
                                      ["n_pieces", "ids_sha256"])


@query("op5_sentencepiece")
def op5_sentencepiece(spark: SparkSession, folder: str):
    """Per document the number of pieces, the SHA-256 of its ids as little-endian 32-bit numbers, and whether decoding gives the text back."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    model = load()
    both = decode(encode(docs, model), model).withColumn("__digest", _digest("ids"))
    return both.select("doc_id", "__digest.*", F.col("decoded").eqNullSafe(F.col("text")).alias("same"))
