"""Long exact spans shared between records: a log-structured fingerprint index.

Of every ``SPAN`` consecutive characters at least one window of ``GRAM``
characters is a fingerprint: the least hash among the windows that lie in the
span.  Two texts with a common span therefore share a fingerprint at the same
place of it.  Fingerprints of a batch form a *run*: an immutable table in the
shared folder, bucketed and sorted by hash.  A new batch is merge-joined with
itself and with each earlier run without moving the runs, the meetings are
verified on the characters, and once there are ``FAN`` runs they are compacted
into one.  A manifest beside the runs names those that count, so an index can be
opened again in another session and appended to.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomfold.llm.arrays import U, chunks, code_points, prefix, sliding_min, stretch_hash, strings
from loomfold.llm.expansion import expanded
from loomfold.sources.shared import checkpoint, shared_path

SPAN = 160
GRAM = 80
#: Runs that are kept before they are compacted into one.
FAN = 2
#: Batches in which the queries put the rows into the index.
BATCHES = 3
#: A hash with more places than HOT in a run is met in SALTS parts, each by a task of its own.
HOT, SALTS = 1_000, 64
_PLACE = 22


def fingerprints_of(texts: list[str], span: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(text, place, hash)`` of the fingerprints of ``texts``; of equal hashes the last in a span counts."""
    cp, ends = code_points(texts)
    n = len(cp) - gram + 1
    wide = span - gram + 1
    none = np.zeros(0, dtype=np.int64)
    if n < wide or len(cp) >= 1 << _PLACE and len(texts) > 1:
        return none, none, none.astype(U)
    sums = prefix(cp)
    h = stretch_hash(sums, slice(0, n), slice(gram, None))
    low = U((1 << _PLACE) - 1)
    place = np.arange(n, dtype=np.int64).astype(U) & low
    least = sliding_min((h & ~low) | (low - place), wide)
    base = np.arange(len(least), dtype=np.int64)
    at = base + ((((low - (least & low)) - (base.astype(U) & low)) & low).astype(np.int64))
    owner = np.repeat(np.arange(len(texts)), np.diff(ends))
    at = at[owner[: len(least)] == owner[span - 1 : span - 1 + len(least)]]
    at = at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at
    return owner[at], at - ends[owner[at]], h[at]


def fingerprints(docs: DataFrame, key: str, text: str, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """``(h, doc, pos, before)``: ``before`` is the hash of the fingerprint before, where the
    two overlap or touch: two texts that also agree in ``before`` met there already."""
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0), strings(batch.column(1))
            for a, b in chunks(texts):
                owner, pos, h = fingerprints_of(texts[a:b], span, gram)
                if not len(owner):
                    continue
                near = np.concatenate([[False], (owner[1:] == owner[:-1]) & (pos[1:] - pos[:-1] <= gram)])
                step = np.concatenate([[0], pos[1:] - pos[:-1]])
                before = np.concatenate([[U(0)], h[:-1]]) + step.astype(U)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), keys.take(pa.array(owner + a)), pa.array(pos, pa.int32()), pa.array(before.view(np.int64), mask=~near)],
                    ["h", "doc", "pos", "before"],
                )

    return docs.select(key, text).filter(F.length(text) >= span).mapInArrow(run, f"h long, doc {kind}, pos int, before long")


class SpanIndex:
    """Runs of fingerprints by hash, oldest first, in the folder ``root``.

    A folder that holds an index is opened as it was left; any other starts
    empty.  ``add`` appends a batch and gives its meetings, ``compact`` makes one
    run of all, ``close`` forgets the tables of this session and deletes the
    files that no run needs any more.  Every change is a new manifest, so a job
    that fails leaves the index as it was.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.root = root or shared_path(spark, "index")
        self.runs: list[str] = []
        self.paths: dict[str, str] = {}
        self.hot: dict[str, DataFrame | None] = {}
        self.version, held = self._last()
        self.buckets = held["buckets"] if held else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        for run in held["runs"] if held else ():
            name = self._name()
            fields = ", ".join(f"`{f}` {t}" for f, t in run["schema"])
            spark.sql(f"CREATE TABLE {name} ({fields}) USING parquet CLUSTERED BY (h) SORTED BY (h) INTO {self.buckets} BUCKETS LOCATION '{run['path']}'")
            self._know(name, run["path"])
            self.runs.append(name)

    @staticmethod
    def _name() -> str:
        return f"loomfold_run_{uuid.uuid4().hex}"

    def _folder(self, at: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _last(self) -> tuple[int, dict | None]:
        """The number and the content of the last whole manifest."""
        path, fs = self._folder(f"{self.root}/manifest")
        if not fs.exists(path):
            return 0, None
        done = [int(f.getPath().getName()) for f in fs.listStatus(path) if fs.exists(self._folder(f"{f.getPath()}/_SUCCESS")[0])]
        return (max(done), json.loads(self.spark.read.text(f"{self.root}/manifest/{max(done)}").first()[0])) if done else (0, None)

    def _commit(self) -> None:
        runs = [{"path": self.paths[r], "schema": self.spark.table(r).dtypes} for r in self.runs]
        self.version += 1
        self.spark.createDataFrame([(json.dumps({"buckets": self.buckets, "runs": runs}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.root}/manifest/{self.version}")

    def _know(self, name: str, path: str) -> None:
        self.paths[name] = path
        # a run is bucketed by hash: this moves no row
        hot = checkpoint(self.spark.table(name).groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") > HOT).select("h"))
        self.hot[name] = None if hot.isEmpty() else hot

    def _write(self, prints: DataFrame) -> str:
        name = self._name()
        path = f"{self.root}/{name}"
        prints.repartition(self.buckets, "h").write.bucketBy(self.buckets, "h").sortBy("h").option("path", path).saveAsTable(name)
        self._know(name, path)
        return name

    def _join(self, new: str, old: str) -> DataFrame:
        """Places of the same hash in both runs: a merge join of the runs as they lie, and for hot hashes one in parts."""
        x, y = self.spark.table(new), self.spark.table(old)
        hot = [h for h in {new: self.hot[new], old: self.hot[old]}.values() if h is not None]
        sides = lambda a, b, on: a.select(F.struct("*").alias("x"), *on).join(b.select(F.struct("*").alias("y"), *on).hint("merge"), on).select("x", "y")
        if not hot:
            return sides(x, y, ["h"])
        keys = hot[0] if len(hot) == 1 else hot[0].union(hot[1]).distinct()
        calm = sides(x.join(keys, "h", "left_anti"), y.join(keys, "h", "left_anti"), ["h"])
        part = F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int")
        few = x.join(keys, "h", "left_semi").withColumn("part", part)
        all_ = y.join(keys, "h", "left_semi").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        busy = sides(few, all_, ["h", "part"]).select(*[F.struct(*[F.col(f"{s}.{c}").alias(c) for c in ("h", "doc", "pos", "before")]).alias(s) for s in "xy"])
        return calm.select(*[F.struct(*[F.col(f"{s}.{c}").alias(c) for c in ("h", "doc", "pos", "before")]).alias(s) for s in "xy"]).unionByName(busy)

    def compact(self) -> None:
        """Makes one run of all.  The old ones stay until ``close``, as lazy results may read them."""
        if len(self.runs) > 1:
            every = self.spark.table(self.runs[0])
            for r in self.runs[1:]:
                every = every.unionByName(self.spark.table(r))
            self.runs = [self._write(every)]
            self._commit()

    def close(self) -> None:
        """Drops this session's tables and deletes the runs that were compacted; results of ``add`` must be written by then."""
        for name, path in self.paths.items():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            if name not in self.runs:
                at, fs = self._folder(path)
                fs.delete(at, True)
        self.paths = {r: self.paths[r] for r in self.runs}

    def add(self, prints: DataFrame) -> DataFrame:
        """``(a, pos_a, b, pos_b)``: where a text of the batch meets another of the batch or
        of an earlier one, once for each stretch of fingerprints both have; a < b."""
        new = self._write(prints)
        met = None
        for old in [*self.runs, new]:
            both = self._join(new, old).filter(
                (F.col("x.doc") < F.col("y.doc") if old == new else F.col("x.doc") != F.col("y.doc"))
                & F.coalesce(F.col("x.before") != F.col("y.before"), F.lit(True))
            )
            first = F.col("x.doc") < F.col("y.doc")
            pick = lambda c, f=first: (F.when(f, F.col(f"x.{c}")).otherwise(F.col(f"y.{c}")), F.when(f, F.col(f"y.{c}")).otherwise(F.col(f"x.{c}")))
            (a, b), (pa_, pb) = pick("doc"), pick("pos")
            part = both.select(a.alias("a"), pa_.alias("pos_a"), b.alias("b"), pb.alias("pos_b"))
            met = part if met is None else met.unionByName(part)
        self.runs.append(new)
        self._commit()
        if len(self.runs) >= FAN:
            self.compact()
        return met


def _agree(left: str, right: str, most: int) -> int:
    """How many characters two texts have in common from their beginning, ``most`` at most."""
    n = min(len(left), len(right), most)
    if left[:n] == right[:n]:
        return n
    lo, hi = 0, n
    while lo + 1 < hi:
        mid = (lo + hi) // 2
        if left[:mid] == right[:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def verified(met: DataFrame, docs: DataFrame, key: str, text: str, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """The distinct pairs ``(a, b)`` of the distinct meetings ``met`` whose texts have a common stretch of ``span``
    characters over the meeting: only ``span`` - ``gram`` characters on either side matter."""
    side = span - gram
    wanted = met.select(F.col("a").alias("doc"), F.col("pos_a").alias("pos")).union(met.select("b", "pos_b")).distinct()
    around = checkpoint(
        wanted.groupBy("doc").agg(F.collect_set("pos").alias("at"))
        .join(docs.select(F.col(key).alias("doc"), F.col(text).alias("_t")), "doc")
        .select("doc", F.explode("at").alias("pos"), "_t")
        .select("doc", "pos", F.expr(f"substring(_t, greatest(pos - {side}, 0) + 1, least(pos, {side}))").alias("l"), F.expr(f"substring(_t, pos + 1, {span})").alias("r"))
    )
    pairs = met.join(around.select(F.col("doc").alias("a"), F.col("pos").alias("pos_a"), F.col("l").alias("la"), F.col("r").alias("ra")), ["a", "pos_a"]).join(
        around.select(F.col("doc").alias("b"), F.col("pos").alias("pos_b"), F.col("l").alias("lb"), F.col("r").alias("rb")), ["b", "pos_b"]
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (la, ra, lb, rb) in enumerate(zip(*(batch.column(n).to_pylist() for n in ("la", "ra", "lb", "rb")), strict=True)):
                after = _agree(ra, rb, span)
                if after >= gram and after + _agree(la[::-1], lb[::-1], side) >= span:
                    keep.append(i)
            yield batch.take(pa.array(keep, pa.int64())).select(["a", "b"])

    kinds = dict(met.dtypes)
    return pairs.select("a", "b", "la", "ra", "lb", "rb").mapInArrow(run, f"a {kinds['a']}, b {kinds['b']}").distinct()


def shared_stretches(met: DataFrame, docs: DataFrame, key: str, text: str, span: int = SPAN) -> DataFrame:
    """``(doc, start, stop)`` of each text of ``met``: the whole common stretches of at least ``span`` characters over its meetings."""
    seeds = met.groupBy("a", "b").agg(F.collect_set(F.struct("pos_a", "pos_b")).alias("at"))
    whole = docs.select(F.col(key).alias("doc"), F.col(text).alias("t"))
    both = seeds.join(whole.withColumnsRenamed({"doc": "a", "t": "ta"}), "a").join(whole.withColumnsRenamed({"doc": "b", "t": "tb"}), "b")
    kind = dict(met.dtypes)["a"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = set()
            for a, b, at, ta, tb in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "at", "ta", "tb")), strict=True):
                x, y = (np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32) for t in (ta, tb))
                for shift in {p["pos_a"] - p["pos_b"] for p in at}:
                    i, j = max(0, shift), max(0, -shift)
                    n = min(len(x) - i, len(y) - j)
                    breaks = np.flatnonzero(x[i : i + n] != y[j : j + n])
                    edges = np.concatenate([[-1], breaks, [n]])
                    for lo, hi in zip(edges[:-1] + 1, edges[1:], strict=True):
                        if hi - lo >= span:
                            rows |= {(a, i + int(lo), i + int(hi)), (b, j + int(lo), j + int(hi))}
            cols = list(zip(*rows, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.column(0).type), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32())], ["doc", "start", "stop"])

    return both.select("a", "b", "at", "ta", "tb").mapInArrow(run, f"doc {kind}, start int, stop int").distinct()


def _covered(stretches: DataFrame) -> DataFrame:
    """``(doc, shared)``: the characters under the stretches of each text, overlaps once."""
    w = Window.partitionBy("doc").orderBy("start", "stop")
    before = F.coalesce(F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return stretches.select("doc", F.greatest(F.col("stop") - F.greatest("start", before), F.lit(0)).alias("n")).groupBy("doc").agg(F.sum("n").alias("shared"))


def _classes(docs: DataFrame, key: str, text: str, span: int) -> DataFrame:
    """``(doc, rep)`` of the texts of at least ``span`` characters: ``rep`` is the least key of equal texts."""
    long = docs.filter(F.length(text) >= span).select(F.col(key).alias("doc"), F.unhex(F.sha2(text, 256)).alias("sign"))
    reps = long.groupBy("sign").agg(F.min("doc").alias("rep"))
    return long.join(reps, "sign").select("doc", "rep")


def _meet(docs: DataFrame, key: str, text: str, span: int, gram: int, batches: int) -> tuple[DataFrame, DataFrame]:
    """The classes of equal texts, and where texts of different classes meet; the rows enter the index in ``batches`` by key."""
    classes = checkpoint(_classes(docs, key, text, span))
    copies = classes.filter("doc <> rep")
    index = SpanIndex(docs.sparkSession)
    met = None
    for i in range(batches):
        batch = docs.filter(F.pmod(F.xxhash64(key), F.lit(batches)) == i)
        part = index.add(fingerprints(batch, key, text, span, gram).join(copies.select("doc"), "doc", "left_anti").select("h", "doc", "pos", "before"))
        met = part if met is None else met.unionByName(part)
    met = checkpoint(met.distinct())
    index.close()
    return classes, met


def class_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN, gram: int = GRAM, batches: int = BATCHES) -> tuple[DataFrame, DataFrame]:
    """``(doc, rep)``, the class of each text that is long enough, and ``(a, b)``, the classes whose texts have a common
    stretch of at least ``span`` characters, by their first rows."""
    classes, met = _meet(docs, key, text, span, gram, batches)
    return classes, verified(met, docs, key, text, span, gram)


def shared_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN, gram: int = GRAM, batches: int = BATCHES) -> DataFrame:
    """``(doc_a, doc_b)``, doc_a < doc_b: rows whose texts have a common stretch of at least ``span`` characters.

    Equal texts are one class: only its first row is indexed, and the pairs are
    carried over to all rows.  Null, empty and shorter texts share nothing.
    Keys must be distinct.
    """
    classes, pairs = class_pairs(docs, key, text, span, gram, batches)
    members = classes.select(F.col("rep").alias("cls"), F.col("doc").alias("id"))
    doubled = classes.filter("doc <> rep").select(F.col("rep").alias("a"), F.col("rep").alias("b")).distinct()
    low, high = F.least("id_a", "id_b"), F.greatest("id_a", "id_b")
    every = expanded(pairs.select("a", "b").unionByName(doubled), members)
    return every.filter("a <> b OR id_a < id_b").select(low.alias("doc_a"), high.alias("doc_b"))


def shared_links(docs: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN, gram: int = GRAM, batches: int = BATCHES) -> DataFrame:
    """``(key, rep, n_links)`` for every row: its class of equal texts, named by its first row, and the number of other
    rows its text shares a stretch of at least ``span`` characters with.  Classes stay folded: no pair of copies is made.
    Null, empty and shorter texts have themselves as ``rep`` and no links."""
    classes, pairs = class_pairs(docs, key, text, span, gram, batches)
    size = classes.groupBy("rep").agg(F.count("*").alias("n"))
    ways = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    other = ways.join(size.withColumnRenamed("rep", "b"), "b").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("m"))
    known = classes.join(size, "rep").join(other, "rep", "left").select(F.col("doc").alias(key), "rep", (F.col("n") - 1 + F.coalesce("m", F.lit(0))).alias("n_links"))
    return docs.select(key).join(known, key, "left").select(key, F.coalesce("rep", key).alias("rep"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def shared_amount(docs: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN, gram: int = GRAM, batches: int = BATCHES) -> DataFrame:
    """``(key, n_chars, shared_chars, share)`` for every row: how much of its text lies in stretches of at least ``span``
    characters that another row has too.  A text that comes twice is shared as a whole; null and empty texts have 0 of 0."""
    classes, met = _meet(docs, key, text, span, gram, batches)
    own = _covered(shared_stretches(met, docs, key, text, span)).withColumnRenamed("doc", "rep")
    twice = classes.groupBy("rep").agg((F.count("*") > 1).alias("twice"))
    known = classes.join(own, "rep", "left").join(twice, "rep").select(F.col("doc").alias(key), "shared", "twice")
    n = F.coalesce(F.length(text), F.lit(0))
    every = docs.select(key, n.alias("n_chars")).join(known, key, "left")
    shared = F.when(F.col("twice"), F.col("n_chars")).otherwise(F.coalesce("shared", F.lit(0))).cast("int")
    return every.select(key, "n_chars", shared.alias("shared_chars")).withColumn("share", F.when(F.col("n_chars") > 0, F.round(F.col("shared_chars") / F.col("n_chars"), 6)).otherwise(F.lit(0.0)))
