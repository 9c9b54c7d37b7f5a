"""MinHash near-dedup: HyperMinHash registers, banding, exact verification.

A document's set of shingles is hashed into registers, each the least hash of
one bucket compressed to its count of leading zeros and the mantissa bits that
follow.  Equal sets form one class, found by aggregation.  Bands of compressed
registers bring classes together; within a band the Jaccard similarity is
estimated from the registers, corrected for chance collisions of compressed
values, and classes that may be similar enough are joined to loose components.
Each loose component is then verified on full sets, and the verified links give
the components.

Nothing emits the pairs of a group.  A task compares the members of a group in
arrays and emits a spanning forest of what it found, at most one edge a member.
Members of a group beyond a block's size are first compared with a few leaders
of it, which takes rows in proportion to the group.  Only those that are then
still apart from most of the group are dealt to blocks, and each of these blocks
meets every other one; pairs that are connected already are not compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components, forest
from .textbatch import _GOLD, Texts, checkpoint, grouped, mix, shuffle_width, slices, small_batches, windows

_U = np.uint64
_S1, _S2, _S3, _DOC = _U(0xA0761D6478BD642F), _U(0xE7037ED1A0B428DB), _U(0x8EBC6AF09C88C6E3), _U(0xD6E8FEB86659FD93)
MANTISSA_BITS = 10
#: Bits of the hash that a register is made of.
VALUE_BITS = 40


@dataclass(frozen=True)
class Rule:
    """``percent``: least similarity of a link.  ``rows`` registers make a band.

    With 120 registers, a pair just at 85 % is missed by all 24 bands of five
    with a chance below one in a million, one at 80 % by all 30 bands of four
    with a chance near one in ten million.
    """

    percent: int = 85
    width: int = 5
    registers: int = 120
    rows: int = 5
    deviations: float = 4.5
    block: int = 256


def shingles(texts: Texts, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of the documents, and each one's document."""
    import pandas as pd

    h = texts.word_hashes()
    o = texts.word_offsets
    n = np.diff(o)
    doc = np.repeat(np.arange(texts.n), n)
    s, inside = windows(h, width, o)
    s, doc = s[inside], doc[inside]
    for few in range(1, width):  # fewer words: the whole sequence
        short = np.flatnonzero(n == few)
        if len(short):
            whole = windows(h, few, o)[0][o[:-1][short]]
            s, doc = np.concatenate([s, mix(whole + _U(few))]), np.concatenate([doc, short])
    order = np.argsort(doc, kind="stable")
    s, doc = s[order], doc[order]
    new = ~pd.Series(mix(s + doc.astype(_U) * _DOC)).duplicated().to_numpy()
    return s[new], doc[new]


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, _U), np.cumsum(values, dtype=_U)])
    return total[offsets[1:]] - total[offsets[:-1]]


def set_keys(s: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 128-bit key of each set of shingles, the same in whatever order."""
    return np.stack([_sums(mix(s ^ _S1), offsets), _sums(mix(s ^ _S2), offsets)], 1)


@lru_cache(maxsize=4)
def _probes(m: int) -> np.ndarray:
    """For each register, the order in which an empty one looks at the others."""
    random = np.random.default_rng(11)
    return np.stack([random.permutation(np.delete(np.arange(m), j)) for j in range(m)], 1)


def hyper_registers(s: np.ndarray, doc: np.ndarray, n: int, m: int) -> np.ndarray:
    """Compressed registers (leading zeros and mantissa, 16 bits) of each document, empty ones filled from others."""
    out = np.zeros((n, m), np.uint16)
    if len(s):
        bucket = ((s >> _U(32)) * _U(m)) >> _U(32)
        key = ((doc.astype(_U) * _U(m) + bucket) << _U(VALUE_BITS)) | (mix(s ^ _S3) >> _U(64 - VALUE_BITS))
        key = np.sort(key)
        place = key >> _U(VALUE_BITS)
        first = np.r_[True, place[1:] != place[:-1]]
        value = (key[first] & _U((1 << VALUE_BITS) - 1)).astype(np.int64)
        zeros = VALUE_BITS - np.frexp(value.astype(float))[1]
        zeros = np.where(value == 0, VALUE_BITS - MANTISSA_BITS - 1, np.minimum(zeros, VALUE_BITS - MANTISSA_BITS - 1))
        mantissa = (value >> (VALUE_BITS - 1 - zeros - MANTISSA_BITS)) & ((1 << MANTISSA_BITS) - 1)
        out.reshape(-1)[place[first].astype(np.int64)] = ((zeros << MANTISSA_BITS) | mantissa) + 1
    # optimal densification: an empty register takes the first filled one of its own order
    filled = out > 0
    rows = np.flatnonzero(filled.any(1) & ~filled.all(1))
    if len(rows):
        raw, full, have = out[rows], out[rows].copy(), filled[rows]
        for probe in _probes(m):
            r, j = np.nonzero(full == 0)
            if not len(r):
                break
            full[r, j] = np.where(have[r, probe[j]], raw[r, probe[j]], 0)
        out[rows] = full
    return out


@lru_cache(maxsize=1)
def collision_table() -> np.ndarray:
    """Chance that registers of disjoint sets agree, by log2 of the two sets' members in a bucket."""
    zeros = np.arange(VALUE_BITS - MANTISSA_BITS)[:, None]
    width = 2.0 ** (-zeros - 1 - MANTISSA_BITS)
    low = 2.0 ** (-zeros - 1) + np.arange(1 << MANTISSA_BITS)[None, :] * width
    low, high = low.ravel(), (low + width).ravel()
    sizes = 2.0 ** np.arange(0, 21)
    p = np.stack([(1 - low) ** n - np.maximum(1 - high, 0) ** n for n in sizes])
    return p @ p.T


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard similarity from registers, corrected for chance agreement of compressed values."""
    m = a.shape[-1]
    level = lambda n: np.clip(np.rint(np.log2(np.maximum(n / m, 1))), 0, 20).astype(np.int64)
    chance = collision_table()[level(na), level(nb)]
    return ((a == b).mean(-1) - chance) / (1 - chance)


def least_estimate(rule: Rule, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Estimates below this are no link, but for a chance of ``deviations`` standard deviations."""
    t = rule.percent / 100
    return t - rule.deviations * np.sqrt(t * (1 - t) / np.clip(np.minimum(na, nb), 1, rule.registers))


def _check(text: str) -> Column:
    """A checksum that tells rows of one id and different texts apart."""
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def signatures(docs: DataFrame, rule: Rule, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, check, n_shingles, set_key, registers) of every document; null key and registers for an empty set."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), _check(text).alias("check"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = Texts(part.column(1), lower=True)
            texts.words()
            s, doc = shingles(texts, rule.width)
            n = np.bincount(doc, minlength=texts.n)
            keys = set_keys(s, np.concatenate([[0], np.cumsum(n)]))
            registers = hyper_registers(s, doc, texts.n, rule.registers)
            some = n > 0
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    part.column(2),
                    pa.array(n.astype(np.int64)),
                    pa.array([keys[i].tobytes() if some[i] else None for i in range(texts.n)], pa.binary()),
                    pa.array([registers[i].tobytes() if some[i] else None for i in range(texts.n)], pa.binary()),
                ],
                ["doc_id", "check", "n_shingles", "set_key", "registers"],
            )

    return rows.mapInArrow(run, "doc_id long, check long, n_shingles long, set_key binary, registers binary")


# -- groups -------------------------------------------------------------------

_EDGES = "u long, v long"


def _together(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.repartition(shuffle_width(rows.sparkSession), *keys).sortWithinPartitions(*keys)


def in_blocks(rest: DataFrame, group: str, item: str, block: int) -> DataFrame:
    """Deal the members of each group to blocks and send them to a task for each two blocks of which one is apart.

    ``rest`` has _apart (whether a member is apart from most of its group),
    _n_apart and size (how many are, of how many).  Adds _low and _high (the
    blocks that meet) and _block (a member's own).
    """
    far = F.ceil(F.col("_n_apart") / block).cast("int")
    near = F.ceil((F.col("size") - F.col("_n_apart")) / block).cast("int")
    dealt = rest.withColumns({"_far": far, "_near": near})
    own = F.when(F.col("_apart"), F.pmod(F.xxhash64(item), F.col("_far"))).otherwise(F.col("_far") + F.pmod(F.xxhash64(item), F.col("_near"))).cast("int")
    last = F.when(F.col("_apart"), F.col("_far") + F.col("_near")).otherwise(F.col("_far")) - 1
    each = dealt.withColumn("_block", own).withColumn("_other", F.explode(F.sequence(F.lit(0), last)))
    met = each.withColumn("_low", F.least("_block", "_other")).withColumn("_high", F.greatest("_block", "_other"))
    return _together(met.drop("_far", "_near", "_other", "_apart", "_n_apart", "size"), group, "_low", "_high")


def _edges_of(linked: Callable[[pa.Table, np.ndarray, np.ndarray, np.ndarray], Iterator[tuple[np.ndarray, np.ndarray]]], keys: list[str], item: str):
    """A task that emits a spanning forest of each group's links.

    ``linked`` gets rows, the groups' bounds, each row's block and each row's
    label; rows of one block (of a pair of different ones) or of one label are
    not compared.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in grouped(batches, keys, 20_000):
            name = table.column(item).to_numpy()
            n = table.num_rows
            label = table.column("_label").to_numpy() if "_label" in table.column_names else np.arange(n)
            side = np.arange(n)
            if "_block" in table.column_names:
                own, low, high = (table.column(k).to_numpy() for k in ("_block", "_low", "_high"))
                side = np.where(low == high, side, -1 - own)
            found: list[tuple[int, int]] = []
            for a, b in linked(table, bounds, side, label):
                found += forest(zip(name[a].tolist(), name[b].tolist()))
            stars = set(found)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in stars], pa.int64()), pa.array([y for _, y in stars], pa.int64())], ["u", "v"])

    return run


def _joined(label: np.ndarray, i: int, hits: np.ndarray) -> None:
    """Give the rows ``hits``, and all that have their labels, the label of row i."""
    if len(hits):
        label[np.isin(label, label[hits])] = label[i]


def _registers(column: pa.ChunkedArray, rule: Rule) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, rule.registers)


def may_link(rule: Rule, a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Whether sets of so many shingles and with such registers may be similar enough."""
    ok = estimate(a, b, na, nb) >= least_estimate(rule, na, nb)
    return ok & (100 * np.minimum(na, nb) >= rule.percent * np.maximum(na, nb))


def _similar_registers(rule: Rule):
    def linked(table: pa.Table, bounds: np.ndarray, side: np.ndarray, label: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        r, n = _registers(table.column("registers"), rule), table.column("n_shingles").to_numpy()
        sizes = np.diff(bounds)
        for size in np.unique(sizes[(sizes > 1) & (sizes <= 8)]):  # small groups: all of one size at once
            begin = bounds[:-1][sizes == size]
            i, j = np.triu_indices(size, 1)
            a, b = (begin[:, None] + i).ravel(), (begin[:, None] + j).ravel()
            for k in range(0, len(a), 50_000):
                x, y = a[k : k + 50_000], b[k : k + 50_000]
                meet = (side[x] != side[y]) & (label[x] != label[y])
                x, y = x[meet], y[meet]
                ok = may_link(rule, r[x], r[y], n[x], n[y])
                if ok.any():
                    yield x[ok], y[ok]
        for begin, end in zip(bounds[:-1][sizes > 8], bounds[1:][sizes > 8]):
            mine = np.unique(label[begin:end], return_inverse=True)[1]
            got_a, got_b = [], []
            for i in range(begin, end - 1):
                others = np.flatnonzero((side[i + 1 : end] != side[i]) & (mine[i + 1 - begin :] != mine[i - begin])) + i + 1
                if len(others):
                    b = others[may_link(rule, r[i][None], r[others], n[i][None], n[others])]
                    got_a.append(np.full(len(b), i))
                    got_b.append(b)
                    _joined(mine, i - begin, b - begin)
            if got_a:
                yield np.concatenate(got_a), np.concatenate(got_b)

    return linked


def _verified(rule: Rule):
    def linked(table: pa.Table, bounds: np.ndarray, side: np.ndarray, label: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        import pandas as pd

        sets = table.column("shingles").to_pylist()
        for begin, end in zip(bounds[:-1], bounds[1:]):
            if end - begin < 2:
                continue
            parts = [np.frombuffer(b, _U) for b in sets[begin:end]]
            n = np.fromiter(map(len, parts), np.int64, len(parts))
            at = np.concatenate([[0], np.cumsum(n)])
            codes, known = pd.factorize(np.concatenate(parts))
            mark = np.zeros(len(known), bool)
            mine, where = np.unique(label[begin:end], return_inverse=True)[1], side[begin:end]
            got_a, got_b = [], []
            for i in range(len(parts) - 1):
                apart = (where[i + 1 :] != where[i]) & (mine[i + 1 :] != mine[i])
                if not apart.any():
                    continue
                own = codes[at[i] : at[i + 1]]
                mark[own] = True
                shared = np.add.reduceat(mark[codes[at[i + 1] :]], at[i + 1 : -1] - at[i + 1], dtype=np.int64)
                mark[own] = False
                ok = apart & (100 * shared >= rule.percent * (n[i] + n[i + 1 :] - shared))
                b = np.flatnonzero(ok) + i + 1
                got_a.append(np.full(len(b), begin + i))
                got_b.append(begin + b)
                _joined(mine, i, b)
            if got_a:
                yield np.concatenate(got_a), np.concatenate(got_b)

    return linked


def _register_stars(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b])
            ok = may_link(rule, _registers(t.column("registers"), rule), _registers(t.column("_registers"), rule), t.column("n_shingles").to_numpy(), t.column("_n_shingles").to_numpy())
            yield pa.RecordBatch.from_arrays([b.column("class"), b.column("_leader")], ["u", "v"]).filter(pa.array(ok))

    return run


def _set_stars(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column("shingles").to_pylist(), b.column("_shingles").to_pylist()):
                shared = len(np.intersect1d(np.frombuffer(x, _U), np.frombuffer(y, _U), assume_unique=True))
                ok.append(100 * shared >= rule.percent * (len(x) // 8 + len(y) // 8 - shared))
            yield pa.RecordBatch.from_arrays([b.column("class"), b.column("_leader")], ["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return run


def linked_classes(members: Callable[[str], DataFrame], group: str, payload: list[str], linked, stars, rule: Rule) -> DataFrame:
    """Connected components (node, component) of the links within groups.

    ``members`` gives the rows (group, size, class, payload) that fit a
    condition.  Groups of up to ``rule.block`` members are compared as a whole.
    Larger ones are compared with four leaders each, in parts of ``rule.block``;
    what is then not connected with most of its group is compared with all of
    it, in pairs of blocks.
    """
    small = _together(members(f"size <= {rule.block}").drop("size"), group).mapInArrow(_edges_of(linked, [group], "class"), _EDGES)
    large = members(f"size > {rule.block}")
    parts = F.ceil(F.col("size") / rule.block).cast("int")
    order = F.xxhash64(F.lit(3), "class")
    ends = [F.min("class"), F.max("class"), F.min_by("class", order), F.max_by("class", order)]
    leaders = checkpoint(large.select(group, "size", "class").groupBy(group, "size").agg(F.array_distinct(F.array(*ends)).alias("leaders")))
    if leaders.isEmpty():
        return connected_components(small)
    named = leaders.select(group, "size", F.explode("leaders").alias("class")).join(large.drop("size"), [group, "class"])
    copies = named.select(group, F.explode(F.sequence(F.lit(0), parts - 1)).alias("_part"), F.col("class").alias("_leader"), *[F.col(c).alias(f"_{c}") for c in payload])
    dealt = large.withColumn("_part", F.pmod(F.xxhash64("class"), parts).cast("int"))
    near = dealt.join(copies, [group, "_part"]).where(F.col("class") != F.col("_leader")).select("class", "_leader", *payload, *[f"_{c}" for c in payload])
    found = connected_components(small.unionByName(near.mapInArrow(stars, _EDGES)))
    labels = found.select(F.col("node").alias("class"), F.col("component").alias("_label"))
    labelled = large.join(labels, "class", "left").withColumn("_label", F.coalesce("_label", "class"))
    most = labelled.groupBy(group, "size", "_label").agg(F.count("*").alias("n"))
    most = most.groupBy(group, "size").agg(F.max_by("_label", F.struct("n", "_label")).alias("_most"), (F.col("size") - F.max("n")).alias("_n_apart")).where("_n_apart > 0")
    most = checkpoint(most)
    if most.isEmpty():
        return found
    spread = most.select(group, "_most", "_n_apart", F.explode(F.sequence(F.lit(0), parts - 1)).alias("_part"))
    rest = labelled.withColumn("_part", F.pmod(F.xxhash64("class"), parts).cast("int")).join(spread, [group, "_part"]).drop("_part")
    rest = rest.withColumn("_apart", F.col("_label") != F.col("_most")).drop("_most")
    more = in_blocks(rest, group, "class", rule.block).mapInArrow(_edges_of(linked, [group, "_low", "_high"], "class"), _EDGES)
    return connected_components(more.unionByName(found.select(F.col("node").alias("u"), F.col("component").alias("v"))))


def _with_sets(rows: DataFrame, rule: Rule) -> DataFrame:
    """Full sets of shingles of (component, size, class, set_key, text) rows, a class once for each part of a task; rows whose text has another set are dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part in slices(batches):
            name = part.column("class").to_pylist()
            new = []
            for c in name:
                new.append(c not in seen)
                seen.add(c)
            part = part.filter(pa.array(new))
            if not part.num_rows:
                continue
            texts = Texts(part.column("text"), lower=True)
            texts.words()
            s, doc = shingles(texts, rule.width)
            at = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=texts.n))])
            keys = set_keys(s, at)
            wanted = part.column("set_key").to_pylist()
            fits = pa.array([keys[i].tobytes() == wanted[i] for i in range(texts.n)])
            listed = pa.array([s[at[i] : at[i + 1]].tobytes() for i in range(texts.n)], pa.binary())
            out = pa.RecordBatch.from_arrays([part.column(k) for k in ("component", "size", "class")] + [listed], ["component", "size", "class", "shingles"])
            yield out.filter(fits)

    return rows.mapInArrow(run, "component long, size long, class long, shingles binary")


def near_duplicates(docs: DataFrame, rule: Rule = Rule(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's number of shingles, its component, and whether it is the one that stays (doc_id, n_shingles, component_id, kept).

    Documents are linked if their sets have a Jaccard similarity of
    ``rule.percent`` or more; component_id is the least doc_id that links lead
    to.  A text of fewer words than a shingle has one shingle, the whole of it.
    A text without words has none and is alone.  Every input row gives one row;
    repeated rows and ids are linked like others of equal text, and of rows with
    one id and one text the kept ones are all kept.  Null ids come after others.
    """
    return _components(docs, rule, doc_id, text).drop("check", "stays")


def _components(docs: DataFrame, rule: Rule, doc_id: str, text: str) -> DataFrame:
    """near_duplicates with each row's checksum, and whether its id and text are the ones that stay of its component (``stays``)."""
    spark = docs.sparkSession
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "check")
    features = checkpoint(signatures(docs, rule, doc_id, text))
    classes = checkpoint(
        features.where("set_key is not null")
        .groupBy("set_key")
        .agg(F.min("doc_id").alias("first_id"), F.min(place).alias("first"), F.max("n_shingles").alias("n_shingles"), F.max("registers").alias("registers"))
        .withColumn("class", F.monotonically_increasing_id())
    )
    bands, wide = rule.registers // rule.rows, 2 * rule.rows
    hashes = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.substring(F.col("registers"), i * wide + 1, F.lit(wide))))
    banded = classes.select("class", F.explode(hashes).alias("band"))
    shared = checkpoint(banded.groupBy("band").agg(F.count("*").alias("size")).where("size > 1"))
    described = classes.select("class", "n_shingles", "registers")
    met = lambda which: banded.join(shared.where(which), "band").join(described, "class")
    maybe = linked_classes(met, "band", ["registers", "n_shingles"], _similar_registers(rule), _register_stars(rule), rule)
    # aggregated apart from the joins, so that these can be split where a component is large
    sizes = checkpoint(maybe.groupBy("component").agg(F.count("*").alias("size")))
    named = classes.select("class", "set_key", F.col("first.doc_id").alias("_id"), F.col("first.check").alias("_check"))
    wanted = maybe.join(sizes, "component").join(named, F.col("node") == F.col("class"))
    source = docs.select(F.col(doc_id).cast("long").alias("_doc"), _check(text).alias("_sum"), F.col(text).alias("text"))
    texts = wanted.join(source, F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_check") == F.col("_sum"))).select("component", "size", "class", "set_key", "text")
    small_batches(spark)
    sets = checkpoint(_with_sets(texts, rule))
    linked = linked_classes(sets.where, "component", ["shingles"], _verified(rule), _set_stars(rule), rule).withColumnRenamed("node", "class")
    first = checkpoint(linked.join(classes.select("class", "first_id", "first"), "class").groupBy("component").agg(F.min("first_id").alias("_least"), F.min("first").alias("_first")))
    named = classes.select("class", "set_key", "first_id", "first").join(linked.join(first, "component").select("class", "_least", "_first"), "class", "left")
    named = named.select(F.col("set_key").alias("_key"), F.coalesce("_least", "first_id").alias("_component"), F.coalesce("_first", "first").alias("_stays"))
    joined = features.join(named, features["set_key"] == named["_key"], "left")
    component = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("_component"))
    stays = F.col("set_key").isNull() | place.eqNullSafe(F.col("_stays"))
    return joined.select("doc_id", "check", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"), stays.alias("stays"))


def without_near_duplicates(docs: DataFrame, rule: Rule = Rule(percent=80, rows=4), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The document with the least id of each group, with all its columns.

    Rows of one id and one text are one document, of which one row stays.  Of
    near duplicates that share the least id, or have none, the one with the least
    checksum stays.  Texts without words are no duplicates of others.
    """
    names = docs.columns
    key = lambda i, check: F.concat_ws("/", F.coalesce(i.cast("string"), F.lit("-")), check.cast("string"))
    rows = docs.select(F.struct(*names).alias("row"), key(F.col(doc_id).cast("long"), _check(text)).alias("_key"))
    gone = _components(docs, rule, doc_id, text).where("not stays").select(key(F.col("doc_id"), F.col("check")).alias("_key")).distinct()
    # one key for the join and the rows that repeat: texts are shuffled once
    stay = rows.join(gone, "_key", "left_anti").dropDuplicates(["_key"])
    return stay.select(*[F.col("row").getField(n).alias(n) for n in names])
