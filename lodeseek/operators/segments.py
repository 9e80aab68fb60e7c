"""A stored index of entities that takes changes: segments with tombstones, merged on read, compacted by size.

Each change writes one segment, a partition of every table, and never touches older ones: the changed entities with all that derives from them, and the ids
that it supersedes. An entity is live in the latest segment that holds it, unless a later one supersedes it. A manifest names the segments of a version, so a
reader sees one version whole. Compaction writes the latest segments as one as soon as they aren't small against the one before them, so their
number grows with the logarithm of the table.

Tables are bucketed and sorted by what they are joined on, so a search shuffles its own rows alone:

    entities      by id: the mapped columns, doc_len, held (distinct trigrams of all fields), block
    superseded    by id: ids whose rows in older segments are dead
    postings      by (token, block): id, field, tf, positions, doc_len
    prefixes      by prefix: for each block the entities with a token of that prefix (n), the greatest f and the least doc_len among them
    dictionary    by part: the distinct tokens in order, in parts of bounded size; fences has the first and last token of each part
    trigrams      by trigram: id, field
    gram_counts   by trigram: number of entries

A block is a run of neighbouring ids of one segment, of BLOCK entities at most.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens_of, trigrams_of
from ..sources.shared import Folder
from .index import TextIndex, field_trigrams
from .mapping import FIELDS, field_texts

#: Entities of a block and tokens of a part of the dictionary, as powers of two.
BLOCK_BITS, PART_BITS = 10, 12
#: Characters of the longest prefix that has entries of its own.
LONGEST_PREFIX = 24
#: The latest segments are compacted while together they have at least one row for so many of the segment before them.
GROWTH = 4
#: Tokens of the longest entity that is counted within its row, by comparing all with all.
SHORT = 64
#: Bits that number blocks and parts within a segment.
WITHIN = 44

KEYS = {
    "entities": ["id"], "superseded": ["id"], "postings": ["token", "block"], "prefixes": ["prefix"], "dictionary": ["part"], "fences": ["part"], "trigrams": ["trigram"], "gram_counts": ["trigram"],
}


@dataclass(frozen=True)
class Manifest:
    """One version: its segments in order with their numbers of rows, live entities and the sum of their lengths, and what never changes."""

    version: int
    segments: list[int]
    rows: list[int]
    docs: int
    length: int
    dirty: bool
    buckets: int
    block_bits: int
    schemas: dict[str, str]
    unmapped: list[str]


def _numbered(rows: DataFrame, key: str, bits: int, segment: int, out: str) -> DataFrame:
    """rows in order of a key, with the number of their run of 2^bits rows. The order of runs is that of keys."""
    ordered = rows.repartitionByRange(key).sortWithinPartitions(key)
    return ordered.withColumn(out, F.shiftright(F.monotonically_increasing_id(), bits) + F.lit(segment << WITHIN))


def _postings(stored: DataFrame) -> DataFrame:
    """(token, block, id, field, tf, positions, doc_len) of entities, each id once. Short texts are counted within their row, long ones by groups."""
    each = field_texts(stored, others=("block", "doc_len")).withColumn("tokens", tokens_of(F.col("text")))
    places = lambda t: F.filter(F.sequence(F.lit(0), F.size("tokens") - 1), lambda i: F.get(F.col("tokens"), i) == t)
    inside = F.transform(F.array_distinct("tokens"), lambda t: F.struct(t.alias("token"), places(t).alias("positions")))
    short = each.where(F.col("doc_len") <= SHORT).select("id", "field", "block", "doc_len", F.explode(inside).alias("t")).select("t.token", "block", "id", "field", F.size("t.positions").alias("tf"), "t.positions", "doc_len")
    long = each.where(F.col("doc_len") > SHORT).select("id", "field", "block", "doc_len", F.posexplode("tokens").alias("position", "token"))
    counted = long.groupBy("token", "block", "id", "field", "doc_len").agg(F.count(F.lit(1)).cast("int").alias("tf"), F.sort_array(F.collect_list("position")).alias("positions"))
    return short.unionByName(counted)


def _prefixes(stored: DataFrame) -> DataFrame:
    """(prefix, block, n, max_f, min_len) of entities, each id once. Those of a block come to one task, so that few rows leave it."""
    tokens = F.concat(*[tokens_of(F.coalesce(F.col(c), F.lit(""))) for _, c in FIELDS])
    each = stored.select("id", "block", "doc_len", *[c for _, c in FIELDS]).repartition("block").select("id", "block", "doc_len", tokens.alias("tokens"))
    begins = lambda t: F.transform(F.sequence(F.lit(1), F.least(F.length(t), F.lit(LONGEST_PREFIX))), lambda n: F.substring(t, F.lit(1), n))
    distinct = F.array_distinct(F.flatten(F.transform(F.array_distinct("tokens"), begins)))
    inside = F.transform(distinct, lambda p: F.struct(p.alias("prefix"), F.size(F.filter("tokens", lambda t: F.startswith(t, p))).cast("long").alias("f")))
    short = each.where(F.col("doc_len") <= SHORT).select("block", "doc_len", F.explode(inside).alias("p")).select("p.prefix", "block", "p.f", "doc_len")
    counted = each.where(F.col("doc_len") > SHORT).select("id", "block", "doc_len", F.explode("tokens").alias("token")).groupBy("token", "block", "id", "doc_len").agg(F.count(F.lit(1)).alias("f"))
    begun = counted.select(F.explode(begins(F.col("token"))).alias("prefix"), "block", "id", "doc_len", "f")
    long = begun.groupBy("prefix", "block", "id", "doc_len").agg(F.sum("f").alias("f")).select("prefix", "block", "f", "doc_len")
    return short.unionByName(long).groupBy("prefix", "block").agg(F.count(F.lit(1)).alias("n"), F.max("f").alias("max_f"), F.min("doc_len").alias("min_len"))


class StoredIndex:
    """A version of an index in a folder. create() makes one, open() reads the latest version; apply() and compact() return the next one.

    One writer at a time: a second one fails. Entities are rows as map_entities gives them, one for each id: of rows of a change that share an id, the
    least counts; those with a null id are left out. Texts, fields and trigrams are those of the fields given, the same for all segments.
    """

    def __init__(self, spark: SparkSession, path: str, manifest: Manifest):
        self.spark, self.folder, self.manifest = spark, Folder(spark, path), manifest
        self._names: dict[str, str] = {}

    @staticmethod
    def create(entities: DataFrame, path: str, buckets: int = 16, block_bits: int = BLOCK_BITS) -> StoredIndex:
        """An index of entities in a new folder. Take about one bucket for each 100 MB of postings."""
        unmapped = [f.name for f in entities.schema if f.metadata.get("mapped") is False]
        empty = Manifest(0, [], [], 0, 0, False, buckets, block_bits, {}, unmapped)
        index = StoredIndex(entities.sparkSession, path, empty)
        if index.folder.names():
            raise FileExistsError(f"{path} isn't empty")
        return index._next(entities, None, [], 1)

    @staticmethod
    def open(spark: SparkSession, path: str) -> StoredIndex:
        folder = Folder(spark, path)
        versions = [int(n.split("-")[1]) for n in folder.names() if n.startswith("manifest-")]
        if not versions:
            raise FileNotFoundError(f"no index in {path}")
        return StoredIndex(spark, path, Manifest(**json.loads(folder.read(f"manifest-{max(versions)}"))))

    # Reading

    def table(self, name: str) -> DataFrame:
        """All rows of this version's segments, dead ones included."""
        if name not in self._names:
            known = f"lodeseek_{uuid.uuid4().hex}"
            keys = ", ".join(KEYS[name])
            columns = self.manifest.schemas[name]
            where = f"PARTITIONED BY (segment) CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {self.manifest.buckets} BUCKETS"
            at = f"{self.folder.path}/{name}".replace("'", "''")
            self.spark.sql(f"CREATE TABLE {known} ({columns}, segment long) USING parquet {where} LOCATION '{at}'")
            for s in self.manifest.segments:
                self.spark.sql(f"ALTER TABLE {known} ADD PARTITION (segment={s}) LOCATION '{at}/segment={s}'")
            self._names[name] = known
        return self.spark.table(self._names[name]).where(F.col("segment").isin(self.manifest.segments))

    @cached_property
    def dead(self) -> DataFrame:
        """(id, until): rows of an id in segments before `until` are dead."""
        return self.table("superseded").groupBy("id").agg(F.max("segment").alias("until"))

    @cached_property
    def live(self) -> DataFrame:
        """The live rows of entities: ids and superseded ids lie in the same buckets."""
        rows = self.table("entities")
        if not self.manifest.dirty:
            return rows
        return rows.join(self.dead.withColumnRenamed("id", "gone").hint("merge"), (F.col("id") == F.col("gone")) & (F.col("segment") < F.col("until")), "left_anti")

    @property
    def dirty_blocks(self) -> DataFrame:
        """(block) of blocks with dead rows."""
        return self.table("entities").join(self.dead, "id").where("segment < until").select("block").distinct()

    def entities(self) -> DataFrame:
        """The entities of this version, as map_entities gave them."""
        added = ("segment", "block", "doc_len", "held")
        absent = {"mapped": False}
        return self.live.select(*[F.col(c).alias(c, metadata=absent) if c in self.manifest.unmapped else F.col(c) for c in self.live.columns if c not in added])

    def of_live(self, rows: DataFrame, *columns: str, how: str = "inner") -> DataFrame:
        """rows (id, segment, ...) of live entities, with columns of these. Segments are compared by two inequalities: as a further key of the join they would
        make Spark shuffle the entities, which lie in buckets by id."""
        live = self.live.select(F.col("id").alias("live_id"), F.col("segment").alias("live_segment"), *columns)
        met = rows.join(live.hint("merge"), (F.col("id") == F.col("live_id")) & (F.col("segment") >= F.col("live_segment")) & (F.col("segment") <= F.col("live_segment")), how)
        return met.drop("live_id", "live_segment")

    def _live_rows(self, name: str) -> DataFrame:
        return self.of_live(self.table(name), how="left_semi") if self.manifest.dirty else self.table(name)

    def postings(self) -> DataFrame:
        return self._live_rows("postings").select("token", "id", "field", "tf", "positions")

    def trigrams(self) -> DataFrame:
        return self._live_rows("trigrams").select("trigram", "id", "field")

    def text(self) -> TextIndex:
        """The text index of this version. Its vocabulary may hold tokens of dead rows."""
        return TextIndex(self.postings(), self.live.select("id", F.col("doc_len")), self.table("dictionary").select("token").distinct())

    def close(self) -> None:
        """Forget the tables' names; the files stay."""
        for known in self._names.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {known}")
        self._names.clear()
        for name in ("dead", "live"):
            self.__dict__.pop(name, None)

    # Writing

    def apply(self, upserts: DataFrame | None = None, deletes: DataFrame | None = None) -> StoredIndex:
        """The next version, with entities inserted or replaced by their ids, and others deleted by theirs (id); an id in both is replaced.

        Writes one segment, and compacts where that is due.
        """
        if upserts is None:
            upserts = self.entities().limit(0)
        after = self._next(upserts, deletes, self.manifest.segments, self.manifest.version + 1)
        due = after.due()
        return after.compact(due) if due > 1 else after

    def due(self) -> int:
        """How many of the latest segments are to be compacted: as many as aren't small against the one before them."""
        rows, together, many = self.manifest.rows, 0, 0
        for i in range(len(rows) - 1, 0, -1):
            together += rows[i]
            if together * GROWTH >= rows[i - 1]:
                many = len(rows) - i + 1
        return many

    def compact(self, latest: int | None = None) -> StoredIndex:
        """The next version, with the latest segments (all, if not given) written as one from their live rows. Files of the others don't change."""
        latest = len(self.manifest.segments) if latest is None else latest
        keep, merged = self.manifest.segments[: len(self.manifest.segments) - latest], self.manifest.segments[len(self.manifest.segments) - latest :]
        rows = self.live.where(F.col("segment").isin(merged)).select(*self.entities().columns)
        gone = self.table("superseded").where(F.col("segment").isin(merged)).select("id") if keep else None
        return self._next(rows, gone, keep, self.manifest.version + 1, of=merged)

    def vacuum(self) -> list[int]:
        """Delete the files of segments that this version doesn't hold, and manifests before it; readers of earlier versions must be done. Returns the segments."""
        gone = set()
        for name in KEYS:
            for part in self.folder.names(name):
                if part.startswith("segment=") and (s := int(part.split("=")[1])) not in self.manifest.segments:
                    self.folder.delete(f"{name}/{part}")
                    gone.add(s)
        for name in self.folder.names():
            if name.startswith(("manifest-", "claim-")) and int(name.split("-")[1]) < self.manifest.version:
                self.folder.delete(name)
        return sorted(gone)

    def _next(self, entities: DataFrame, gone: DataFrame | None, keep: list[int], version: int, of: list[int] | None = None) -> StoredIndex:
        """Write a segment of entities, which with `gone` supersedes ids of the segments kept; commit the version. of: the segments that it is compacted from."""
        if not self.folder.claim(f"claim-{version}"):
            raise RuntimeError(f"another writer makes version {version} of {self.folder.path}")
        m, schemas = self.manifest, dict(self.manifest.schemas)

        def write(name: str, rows: DataFrame) -> DataFrame:
            """The rows as this segment of a table, one file for each bucket; read back."""
            schemas.setdefault(name, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema))
            passing, keys = f"lodeseek_{uuid.uuid4().hex}", KEYS[name]
            out = rows.repartition(m.buckets, *keys).write.mode("append").format("parquet").bucketBy(m.buckets, *keys).sortBy(*keys)
            at = f"{self.folder.path}/{name}/segment={version}"
            out.option("path", at).saveAsTable(passing)
            self.spark.sql(f"DROP TABLE {passing}")
            return self.spark.read.schema(rows.schema).parquet(at)

        if clash := {"segment", "block", "doc_len", "held", "one"} & set(entities.columns):
            raise ValueError(f"columns of the index itself: {', '.join(sorted(clash))}")
        if m.segments:
            known = self.entities().columns
            if sorted(known) != sorted(entities.columns):
                raise ValueError(f"the index has the columns {', '.join(known)}")
            entities = entities.select(*known)
        others = [c for c in entities.columns if c != "id"]
        one = entities.where("id is not null").groupBy("id").agg(F.min(F.struct(*others)).alias("one")).select("id", "one.*").select(*entities.columns)
        empty = F.array().cast("array<string>")
        held = F.array_distinct(F.concat(*[F.coalesce(trigrams_of(F.col(c)), empty) for _, c in FIELDS]))
        sizes = sum((F.size(tokens_of(F.col(c))) for _, c in FIELDS), start=F.lit(0)).cast("long")
        rows = _numbered(one, "id", m.block_bits, version, "block").withColumn("doc_len", sizes)
        stored = write("entities", rows.withColumn("held", held))
        if keep:
            ids = stored.select("id") if of is None else stored.select("id").limit(0)
            dead = (ids if gone is None else ids.unionByName(gone.select("id"))).where("id is not null").distinct()
        else:
            dead = stored.select("id").limit(0)
        superseded = write("superseded", dead)
        postings = write("postings", _postings(stored))
        write("prefixes", _prefixes(stored))
        words = write("dictionary", _numbered(postings.select("token").distinct(), "token", PART_BITS, version, "part").select("part", "token"))
        write("fences", words.groupBy("part").agg(F.min("token").alias("first"), F.max("token").alias("last")))
        trigrams = write("trigrams", field_trigrams(stored))
        write("gram_counts", trigrams.groupBy("trigram").agg(F.count(F.lit(1)).alias("n")))

        new = stored.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("doc_len"), F.lit(0)).alias("length")).first()
        docs, length = m.docs, m.length
        if of is None:
            lost = self.live.select("id", "doc_len").join(superseded, "id", "left_semi").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("doc_len"), F.lit(0)).alias("length")).first() if keep else None
            docs, length = docs + new["n"] - (lost["n"] if lost else 0), length + new["length"] - (lost["length"] if lost else 0)
        dirty = bool(keep) and (m.dirty or not superseded.isEmpty())
        kept_rows = m.rows[: len(keep)]
        after = Manifest(version, [*keep, version], [*kept_rows, new["n"]], docs, length, dirty, m.buckets, m.block_bits, schemas, m.unmapped)
        self.folder.write(f"manifest-{version}", json.dumps(after.__dict__))
        return StoredIndex(self.spark, self.folder.path, after)


