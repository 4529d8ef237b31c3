"""Records that differ only in how they are written.

Method: an incremental ledger. Every record is reduced to a canonical key; the
ledger keeps, in buckets by key, how many records had the key and which was the
first. A new batch is counted map-side by key, its counts are joined full outer
with those buckets of the ledger that the batch touches, counts are added and
the smallest record id stays as the representative. Buckets the batch does not
touch are neither read nor written. The ledger lasts: it can be closed and opened
again, and a batch that is repeated adds nothing.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadlake.functions.lexical import SPACE
from quadlake.operators.skew import task_rows
from quadlake.session import scratch_path, stage
from quadlake.sources.files import Files

_LEDGER = "key binary, copies bigint, first_id bigint"
#: Marks inside a canonical text: between name and value, and between fields.
_IS, _AND = "\x01", "\x02"
_BREAKS = ";|\n\x0b\x0c\r\x85\u2028\u2029"
_BREAK = f"[{_BREAKS}]"


def fold(text: Column) -> Column:
    """One letter case. Upper case comes first: it has one form for letters with
    two small ones (s, final sigma). Marks become blanks."""
    upper = F.replace(F.upper(text), F.lit("ẞ"), F.lit("SS"))
    return F.translate(F.lower(upper), f"ς{_IS}{_AND}", "σ  ")


def words(folded: Column) -> Column:
    """The words of a folded text, one blank between them. A word is a run of
    letters and digits."""
    return F.trim(F.regexp_replace(folded, r"[^\p{L}\p{N}]+", " "))


def _marked(folded: Column) -> Column:
    """Words with marks: items are cut at breaks, blank ones left out, and the
    first '=' or ':' of each is its mark. No group is repeated: that would take
    stack for every item."""
    breaks = F.translate(F.btrim(folded, F.lit(SPACE + _BREAKS)), _BREAKS, _AND * len(_BREAKS))
    cut = F.regexp_replace(breaks, r"\x02[\x02\s\p{Z}\x{85}\x1c-\x1f]*", _AND)
    named = F.regexp_replace(cut, r"(^|\x02)([^=:\x02]*)[=:]", f"$1$2{_IS}")
    bare = F.regexp_replace(named, r"[^\p{L}\p{N}\x01\x02]+", " ")
    return F.trim(F.regexp_replace(bare, r" ?([\x01\x02]) ?", "$1"))


def with_canonical_text(df: DataFrame, label: str) -> DataFrame:
    """Add _canonical: equal for labels with the same words in the same order,
    and for lists of the same fields in any order.

    A label of two or more items split at ';', '|' or line breaks, each
    ``name = value`` or ``name: value``, is a list of fields; a name needs a
    word, a field given twice counts once. A null label has no words, like an
    empty one. One projection a step, so that no step is computed twice.
    """
    folded = F.col("_folded")
    df = df.withColumn("_folded", fold(F.coalesce(F.col(label), F.lit(""))))
    df = df.withColumn("_marked", F.when(folded.rlike(_BREAK) & folded.rlike("[=:]"), _marked(folded)))
    df = df.withColumn("_items", F.split("_marked", _AND))
    is_list = (F.size("_items") >= 2) & F.forall("_items", lambda x: F.instr(x, _IS) > 1)
    fields = F.array_join(F.array_sort(F.array_distinct("_items")), _AND)
    text = F.when(is_list, F.concat(F.lit("F"), fields)).otherwise(F.concat(F.lit("W"), words(folded)))
    return df.withColumn("_canonical", text).drop("_folded", "_marked", "_items")


def canonical_language(language: Column) -> Column:
    """Without letter case, '_' as '-', null as empty."""
    return F.translate(F.lower(F.coalesce(language, F.lit(""))), "_", "-")


class Ledger:
    """Counts and representatives by canonical key, kept in a folder.

    ``manifests/<version>.json`` says for every bucket which version of it
    holds, and which batch made that version; it is written aside and renamed,
    so a batch is in the ledger as a whole or not at all, and of two writers of
    one version one fails. ``batches/<digest>`` marks every batch that is in, so
    a batch that is added again, after a failure or by mistake, adds nothing.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        """Opens the ledger of a folder, or makes a new one. buckets: of a new
        ledger, by default one for each shuffle partition, which is the number
        of tasks a full load is written by; a ledger keeps its number."""
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark, path.rstrip("/"))
        self.version = max(self._versions(), default=0)
        state = self._manifest(self.version) if self.version else {}
        self.buckets = state.get("buckets") or buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        #: bucket: folder of the version that holds it
        self.held: dict[int, str] = {int(b): v for b, v in state.get("held", {}).items()}
        self._newest = state.get("batch")

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Ledger:
        """A ledger that must already be there."""
        book = cls(spark, path)
        if not book.version:
            raise FileNotFoundError(f"no ledger in {path}")
        return book

    def _versions(self) -> list[int]:
        return [int(n[:-5]) for n in self.files.names("manifests") if n.endswith(".json")]

    def _manifest(self, version: int) -> dict:
        return json.loads(self.files.read(f"manifests/{version:012d}.json"))

    @staticmethod
    def _mark(batch: str) -> str:
        return f"batches/{hashlib.sha256(batch.encode()).hexdigest()}"

    def has(self, batch: str) -> bool:
        """Whether a batch is in the ledger."""
        return batch == self._newest or self.files.exists(self._mark(batch))

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int")

    def _read(self, buckets: list[int]) -> DataFrame:
        paths = [f"{self.path}/{self.held[b]}/bucket={b}" for b in buckets if b in self.held]
        return self.spark.read.schema(_LEDGER).parquet(*paths) if paths else self.spark.createDataFrame([], _LEDGER)

    def rows(self) -> DataFrame:
        """key, copies, first_id of all records so far."""
        return self._read(sorted(self.held))

    def add(self, records: DataFrame, batch: str | None = None) -> bool:
        """Add a batch of key, record_id under its name; False if a batch of
        this name is in already, which changes nothing. Without a name the batch
        is one of its own. An empty batch is only noted.

        Another writer's batch in between raises; the ledger is then to be
        opened again and the batch to be repeated.
        """
        batch = batch or uuid.uuid4().hex
        if self.has(batch):
            return False
        if self._newest is not None:  # its mark, should the writer have ended before it was made
            self.files.create(self._mark(self._newest), self._newest)
        new = records.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("record_id").alias("first"))
        touched = sorted(r[0] for r in records.select(self._bucket()).distinct().collect())  # at most self.buckets numbers
        folder = f"v{self.version + 1}-{uuid.uuid4().hex}"
        if touched:
            both = new.join(self._read(touched), "key", "full_outer").select(
                "key",
                (F.coalesce("n", F.lit(0)) + F.coalesce("copies", F.lit(0))).alias("copies"),
                F.least("first", "first_id").alias("first_id"),
            )
            both.withColumn("bucket", self._bucket()).repartitionById(self.buckets, F.col("bucket")).write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        held = self.held | dict.fromkeys(touched, folder)
        if not self.files.create(f"manifests/{self.version + 1:012d}.json", json.dumps({"buckets": self.buckets, "batch": batch, "held": held})):
            self.files.remove(folder)
            raise RuntimeError("another batch came first")
        self.held, self.version, self._newest = held, self.version + 1, batch
        self.files.create(self._mark(batch), batch)
        return True

    def vacuum(self, keep: int = 2) -> int:
        """Forget all but the newest ``keep`` versions and delete the buckets
        only they used; gives the number of folders deleted. Readers of older
        versions, and a batch that is being added, must have ended."""
        versions = sorted(self._versions())
        kept, old = versions[-keep:], versions[:-keep]
        used = {(v, int(b)) for n in kept for b, v in self._manifest(n)["held"].items()}
        for n in old:
            self.files.remove(f"manifests/{n:012d}.json")
        gone = 0
        for folder in [n for n in self.files.names("") if n.startswith("v")]:
            buckets = [n for n in self.files.names(folder) if n.startswith("bucket=")]
            unused = [b for b in buckets if (folder, int(b.removeprefix("bucket="))) not in used]
            for name in [folder] if len(unused) == len(buckets) else [f"{folder}/{b}" for b in unused]:
                self.files.remove(name)
                gone += 1
        return gone


def keyed_records(df: DataFrame, record_id: str, label: str, language: str, at: str) -> DataFrame:
    """record_id, key (128-bit digest of canonical language and text), at."""
    rows = df.select(F.col(record_id).cast("bigint").alias("record_id"), F.col(label).alias("label"), canonical_language(F.col(language)).alias("language"), F.col(at).alias("at"))
    key = F.unhex(F.md5(F.concat("language", F.lit("\x03"), "_canonical")))
    return with_canonical_text(rows, "label").select("record_id", key.alias("key"), "at")


def in_batches(keyed: DataFrame, batches: int) -> DataFrame:
    """Add _batch, from 0: equal spans of time in the order the records were
    loaded; records without a time come last."""
    at = F.col("at").cast("timestamp").cast("double")
    low, high = keyed.select(F.min(at), F.max(at)).first()
    low, high = (0.0, 0.0) if low is None else (low, high)
    number = F.least(F.floor((at - low) / max((high - low) / batches, 1e-6)), F.lit(batches - 1))
    return keyed.withColumn("_batch", F.coalesce(number, F.lit(batches - 1)))


def build(spark: SparkSession, keyed: DataFrame, batches: int = 2, buckets: int | None = None, path: str | None = None) -> Ledger:
    """A ledger fed with the records in batches, named by their number.

    path: where the ledger stays; without one it lasts as long as the driver.
    Called again with the same records and path it goes on where it was stopped.
    """
    out = Ledger(spark, path or scratch_path(spark, "ledger"), buckets)
    numbered = in_batches(keyed, batches)
    for k in range(batches):
        out.add(numbered.where(F.col("_batch") == k), str(k))
    return out


def copies(keyed: DataFrame, ledger: Ledger, limit: int | None = None) -> DataFrame:
    """first_id and record_id of every record that is not its group's first.

    The groups of more than limit records (by default half of a mean task, so
    at most two such groups a task) are looked up in place; only the other
    records are shuffled to their groups. A record delivered twice is given
    once; null ids are counted but not given.
    """
    least = max(2, (limit or task_rows(keyed, keyed.count())) + 1)
    groups = ledger.rows().where("copies > 1").select("key", "copies", "first_id")
    hot = F.broadcast(groups.where(F.col("copies") >= least).select("key", F.col("first_id").alias("hot_first")))
    rows = keyed.select("key", "record_id").join(hot, "key", "left")
    of_hot = rows.where("hot_first is not null").select(F.col("hot_first").alias("first_id"), "record_id")
    cold = groups.where(F.col("copies") < least).select("key", "first_id")
    of_cold = rows.where("hot_first is null").select("key", "record_id").join(cold, "key").select("first_id", "record_id")
    return of_hot.unionByName(of_cold).where("record_id <> first_id").distinct()


def collapse(spark: SparkSession, df: DataFrame, record_id: str, label: str, language: str, at: str, batches: int = 2) -> tuple[DataFrame, Ledger]:
    """The keyed records, kept in the shared folder, and their ledger.

    Null labels and languages equal empty ones; very long labels are read
    whole; equal rows are copies of each other; of several records the smallest
    id is the representative. Empty input gives an empty ledger.
    """
    keyed = stage(spark, keyed_records(df, record_id, label, language, at), "keyed")
    return keyed, build(spark, keyed, batches)
