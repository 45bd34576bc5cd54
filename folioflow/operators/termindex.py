"""A kept full-text index: a term dictionary in ranges, postings as 64-bit words of bitmaps, and segments for changes.

A posting row is (field, token, w, bits): bit k of the word w stands for the key 64 w + k. Rows are written in order of tokens and
dealt to ranges, one folder each; a small table has the first and last token of every range. A word or a beginning of words reads the
ranges that can hold it, and no other file. "And", "or" and "not" are done on words of bits: one grouping by w for any tree.

Changes make a segment of their own: postings of the new versions, and the keys whose older versions are dead. A search masks
the bits of every segment by the dead keys of all later ones. Segments of one class of size are merged into a new one; what is written is never
changed, and a segment counts as soon as its last folder is complete. Keys are integers (long); a text's nulls have no words; a key that is
given twice in one change counts with all its texts; a key that is inserted again is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import written
from .search import condition, parse_query, tokens

#: Rows of a range of the dictionary, and how many ranges of fewer rows a segment has at most: each is a task, a folder and a file.
RANGE_ROWS, RANGES = 2_000_000, 200
#: Bytes of text whose words a task groups.
TASK_BYTES = 4 << 20
#: Segments of one class of size that are merged, which is also the factor between classes.
FAN = 4
#: The token of the row that has every key of a segment.
ALL = ""

_POSTING = "field string, token string, w long, bits long"
_NAME = re.compile(r"segment-(\d{8})-(\d{8})$")


def _words(df: DataFrame, key: str, fields: Mapping[str, Column]) -> DataFrame:
    """(field, token, w, bits) of all words of the fields, and of ALL. The texts are dealt by w, so their words are grouped where they are found."""
    k = F.col(key).cast("long")
    names = {name: f"_{n}" for n, name in enumerate(fields)}
    texts = df.where(F.col(key).isNotNull()).select(F.shiftright(k, 6).alias("w"), _bit(k).alias("bit"), *(c.cast("string").alias(names[name]) for name, c in fields.items()))
    size = texts.agg(F.sum(sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in names.values()), F.lit(0)))).first()[0] or 0
    of = lambda name, c: F.struct(F.lit(name).alias("field"), c.alias("tokens"))
    parts = [of(name, F.array_distinct(tokens(F.col(c)))) for name, c in names.items()]
    every = F.array(of("", F.array(F.lit(ALL))), *parts)
    dealt = texts.repartition(max(df.sparkSession.sparkContext.defaultParallelism, size // TASK_BYTES + 1), "w")
    rows = dealt.select("w", "bit", F.explode(every).alias("t")).select("w", "bit", "t.field", F.explode("t.tokens").alias("token"))
    return rows.groupBy("field", "token", "w").agg(F.bit_or("bit").alias("bits"))


def _bit(k: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(k, F.lit(64)).cast("int"))


def _none(spark: SparkSession, schema: str) -> DataFrame:
    """No rows, without a Python worker for them."""
    return spark.range(0).select(*(F.lit(None).cast(kind).alias(name) for name, kind in (c.split() for c in schema.split(","))))


@dataclass(frozen=True)
class Segment:
    """A folder with the changes numbered from ``low`` to ``high``."""

    low: int
    high: int
    path: str


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


@dataclass
class TermIndex:
    """The index at a path."""

    spark: SparkSession
    path: str
    range_rows: int = RANGE_ROWS

    # -- segments --------------------------------------------------------------------------------------

    def _folders(self) -> list[Segment]:
        fs, p = _fs(self.spark, self.path)
        if not fs.exists(p):
            return []
        found = []
        for status in fs.listStatus(p):
            if m := _NAME.search(name := status.getPath().toString()):
                if fs.exists(_fs(self.spark, f"{name}/ranges/_SUCCESS")[1]):
                    found.append(Segment(int(m[1]), int(m[2]), name))
        return sorted(found, key=lambda s: (s.low, -s.high))

    def segments(self) -> list[Segment]:
        """The segments that count: complete, and not within a merged one."""
        out: list[Segment] = []
        for s in self._folders():
            if not out or s.high > out[-1].high:
                out.append(s)
        return out

    def _write(self, low: int, high: int, rows: DataFrame, dead: DataFrame) -> Segment:
        """rows: postings, which are read more than once; dead: (w, bits)."""
        path = f"{self.path}/segment-{low:08d}-{high:08d}"
        n_rows = rows.count()
        n = max(1, -(-n_rows // max(self.range_rows, min(RANGE_ROWS, n_rows // RANGES))))
        order = ["token", "field", "w"]
        ranged = rows.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()).sortWithinPartitions(*order)
        ranged.write.mode("overwrite").partitionBy("part").parquet(f"{path}/postings")
        dead.write.mode("overwrite").parquet(f"{path}/dead")
        back = self.spark.read.schema("field string, token string, w long, bits long, part int").parquet(f"{path}/postings")
        back.groupBy("part").agg(F.min("token").alias("first"), F.max("token").alias("last"), F.count(F.lit(1)).alias("rows")).coalesce(1).write.mode("overwrite").parquet(f"{path}/ranges")
        return Segment(low, high, path)

    def apply(self, new: DataFrame | None, key: str, fields: Mapping[str, Column], deleted: DataFrame | None = None) -> Segment:
        """A segment of rows to insert or replace, and of keys (column ``key``) to delete. A deleted key that is also in ``new`` is replaced."""
        number = max((s.high for s in self.segments()), default=-1) + 1
        gone = [df.select(F.col(key).cast("long").alias("k")).where("k is not null") for df in (new, deleted) if df is not None]
        dead = gone[0] if len(gone) == 1 else gone[0].unionByName(gone[1])
        dead = dead.groupBy(F.shiftright("k", 6).alias("w")).agg(F.bit_or(_bit(F.col("k"))).alias("bits"))
        if new is None:
            rows = _none(self.spark, _POSTING)
        else:
            rows = written(_words(new, key, fields), "postings")
        return self._write(number, number, rows, dead)

    # -- reading ---------------------------------------------------------------------------------------

    def _ranges(self, segments: list[Segment]) -> DataFrame:
        out = None
        for k, s in enumerate(segments):
            part = self.spark.read.schema("part int, first string, last string, rows long").parquet(f"{s.path}/ranges").withColumn("seg", F.lit(k))
            out = part if out is None else out.unionByName(part)
        return out

    def _postings(self, segments: list[Segment], terms: list[tuple[str, bool]] | None) -> DataFrame:
        """Rows (seg, field, token, w, bits) of some tokens, or beginnings of tokens, from the ranges that can hold them; of all without ``terms``."""
        parts: dict[int, list[int]] = {k: [] for k in range(len(segments))}
        if terms is not None:
            hit = F.lit(False)
            for t, open_ in terms:
                hit = hit | ((F.col("last") >= t) & ((F.col("first") <= t) | (F.col("first").startswith(t) if open_ else F.lit(False))))
            for r in self._ranges(segments).where(hit).select("seg", "part").collect():  # a row for each range that is read
                parts[r["seg"]].append(r["part"])
        out = None
        for k, s in enumerate(segments):
            rows = self.spark.read.schema("field string, token string, w long, bits long, part int").parquet(f"{s.path}/postings")
            if terms is not None:
                hit = F.lit(False)
                for t, open_ in terms:
                    hit = hit | (F.col("token").startswith(t) if open_ else F.col("token") == t)
                rows = rows.where(F.col("part").isin(parts[k]) & hit)
            rows = rows.select(F.lit(k).alias("seg"), "field", "token", "w", "bits")
            out = rows if out is None else out.unionByName(rows)
        return out

    def _dead(self, segments: list[Segment]) -> DataFrame:
        """(seg, w, dead): of each segment the keys that a later one of the list replaces or deletes."""
        out = None
        for k, s in enumerate(segments[1:], 1):
            rows = self.spark.read.schema("w long, bits long").parquet(f"{s.path}/dead").withColumn("seg", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
            out = rows if out is None else out.unionByName(rows)
        if out is None:
            out = _none(self.spark, "w long, bits long, seg int")
        return out.groupBy("seg", "w").agg(F.bit_or("bits").alias("dead"))

    def matches(self, tree) -> DataFrame:
        """(w, bits) of a tree: (left, "and" or "or", right), ("not", part), or (field or None, word, is a beginning)."""
        segments = self.segments()
        if not segments:
            return _none(self.spark, "w long, bits long")
        leaves: list[tuple] = []

        def compiled(t) -> Column:
            if len(t) == 2 and t[0] == "not":
                return F.bitwise_not(compiled(t[1])).bitwiseAND(F.col("_every"))
            if t[1] in ("and", "or") and isinstance(t[0], tuple):
                a, b = compiled(t[0]), compiled(t[2])
                return a.bitwiseAND(b) if t[1] == "and" else a.bitwiseOR(b)
            if t not in leaves:
                leaves.append(t)
            return F.col(f"_{leaves.index(t)}")

        value = compiled(tree)
        rows = self._postings(segments, [(w, open_) for _, w, open_ in leaves] + [(ALL, False)])
        hit = lambda f, w, open_: (F.col("token").startswith(w) if open_ else F.col("token") == w) & (F.col("token") != ALL) & (F.lit(True) if f is None else F.col("field") == f)
        some = lambda on: F.coalesce(F.bit_or(F.when(on, F.col("bits"))), F.lit(0).cast("long"))
        words = rows.groupBy("seg", "w").agg(some(F.col("token") == ALL).alias("_every"), *(some(hit(*leaf)).alias(f"_{k}") for k, leaf in enumerate(leaves)))
        live = words.join(self._dead(segments), ["seg", "w"], "left")
        bits = value.bitwiseAND(F.bitwise_not(F.coalesce("dead", F.lit(0).cast("long"))))
        return live.select("w", bits.alias("bits")).where("bits != 0").groupBy("w").agg(F.bit_or("bits").alias("bits"))

    def keys(self, matches: DataFrame) -> DataFrame:
        """The keys of (w, bits), in a column ``key``."""
        places = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda k: F.col("bits").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), k)) != 0)
        return matches.select("w", F.explode(places).alias("k")).select((F.col("w") * 64 + F.col("k")).alias("key"))

    def count(self, tree) -> DataFrame:
        """The number of keys, counted on the bits."""
        return self.matches(tree).agg(F.coalesce(F.sum(F.bit_count("bits")), F.lit(0)).cast("long").alias("total"))

    def search(self, table: DataFrame, key: str, query: str, fields: Mapping[str, Column]) -> DataFrame:
        """The table's rows that meet a keyword query. The index finds those with all words; only queries with phrases or ends left open
        inside phrases are checked on the texts of these."""
        parsed = [(f, [w for w in re.split(r"[\W_]+", t.lower().rstrip("*")) if w], t.endswith("*")) for f, t, _ in parse_query(query)]
        leaves = [(f, w, open_ and k == len(words) - 1) for f, words, open_ in parsed for k, w in enumerate(words)]
        tree = None
        for leaf in leaves:
            tree = leaf if tree is None else (tree, "and", leaf)
        if tree is None:
            return table
        found = table.join(self.keys(self.matches(tree)).withColumnRenamed("key", key), key, "left_semi")
        return found.where(condition(query, fields)) if any(len(words) > 1 for _, words, _ in parsed) else found

    def terms(self, beginning: str) -> DataFrame:
        """(field, token, n): the words that begin so, with the number of live keys that have them."""
        segments = self.segments()
        rows = self._postings(segments, [(beginning, True)]).where(F.col("token") != ALL).join(self._dead(segments), ["seg", "w"], "left")
        live = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("dead", F.lit(0).cast("long"))))
        return rows.groupBy("field", "token").agg(F.sum(F.bit_count(live)).cast("long").alias("n")).where("n > 0")

    # -- merging ---------------------------------------------------------------------------------------

    def compact(self) -> list[Segment]:
        """Merges runs of FAN segments or more of one class of size until none is left; the merged ones that were written."""
        done = []
        while True:
            segments = self.segments()
            sizes = {r["seg"]: r["rows"] for r in self._ranges(segments).groupBy("seg").agg(F.sum("rows").alias("rows")).collect()} if segments else {}  # a row for each segment
            kinds = [_size_class(sizes.get(k, 0)) for k in range(len(segments))]
            end = len(segments)
            while end and not (run := _last_run(kinds[:end])):
                end -= 1
            if not end:
                return done
            done.append(self._merge(segments[end - run : end], oldest=end == run))

    def _merge(self, segments: list[Segment], oldest: bool) -> Segment:
        rows = self._postings(segments, None).join(self._dead(segments), ["seg", "w"], "left")
        live = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("dead", F.lit(0).cast("long"))))
        rows = rows.select("field", "token", "w", live.alias("bits")).where("bits != 0").groupBy("field", "token", "w").agg(F.bit_or("bits").alias("bits"))
        dead = None
        for s in segments:
            own = self.spark.read.schema("w long, bits long").parquet(f"{s.path}/dead")
            dead = own if dead is None else dead.unionByName(own)
        dead = dead.where(F.lit(not oldest)).groupBy("w").agg(F.bit_or("bits").alias("bits"))  # there is nothing older to hide
        return self._write(segments[0].low, segments[-1].high, written(rows, "merged"), dead)

    def vacuum(self) -> int:
        """Drops the folders of segments that are within merged ones; their number."""
        kept = set(self.segments())
        old = [s for s in self._folders() if s not in kept]
        for s in old:
            fs, p = _fs(self.spark, s.path)
            fs.delete(p, True)
        return len(old)


def _size_class(rows: int) -> int:
    n = 0
    while rows >= FAN:
        rows //= FAN
        n += 1
    return n


def _last_run(kinds: list[int]) -> int:
    """The length of the run of equal classes at the end, if it is to be merged."""
    n = 0
    while n < len(kinds) and kinds[-1 - n] == kinds[-1]:
        n += 1
    return n if n >= FAN else 0
