"""The article table as a store that takes batches without being rewritten.

Rows are dealt into buckets by the hash of their URL. A batch is folded and written as one more part of each bucket that it touches, nothing else;
a commit, a small file that lists every bucket's parts, then makes it visible. A row that a key has in several parts is folded when it is
read. A bucket's parts are merged from the first one on that is no larger than all that follow it, so each part outweighs all later
ones together: a bucket has at most as many parts as its size has doublings, and a row is written again as often, however
large the store grows.

Defined results: repeated batches (equal source and number) change nothing; a commit that fails leaves the one before; an article goes once it was first found
longer ago than the retention, and begins anew if it is found again after that; null URLs are one key; batches without rows commit their number alone.
A store has one writer at a time: a second one gets an error. The parts of the last `keep` commits stay for their readers, and so does
what each of them added, which `newsflow.sources.changes` reads as a stream.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsflow.operators.store import fold_upserts

#: Digits of a commit's number in its file name.
_DIGITS = 12


class ArticleStore:
    """The store below a path. order: the column of a batch that orders its writes."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, retain_hours: int | None = None, keep: int = 3, key: str = "url", order: str = "seq"):
        self.spark, self.path, self.retain_hours, self.keep, self.key, self.order = spark, path.rstrip("/"), retain_hours, keep, key, order
        self._folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._files = self._folder.getFileSystem(spark._jsc.hadoopConfiguration())
        self.buckets = (self.state() or {"buckets": buckets})["buckets"]

    def _at(self, *names: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *names]))

    def commits(self) -> list[int]:
        folder = self._at("_commits")
        names = [f.getPath().getName() for f in self._files.listStatus(folder)] if self._files.exists(folder) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())

    def state(self, commit: int | None = None) -> dict | None:
        """What a commit, by default the last, says: its number, buckets, parts [[folder, bytes], ...] by bucket, the part that it added to each bucket
        (even if it was merged at once), schema, the last number of every source, the latest find, and the time before which articles have gone."""
        commits = self.commits()
        if not commits:
            return None
        stream = self._files.open(self._at("_commits", f"{commits[-1] if commit is None else commit:0{_DIGITS}}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, state: dict) -> None:
        final, draft = (self._at("_commits", n) for n in (f"{state['commit']:0{_DIGITS}}.json", f"_{uuid.uuid4().hex}"))
        out = self._files.create(draft)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if self._files.exists(final) or not self._files.rename(draft, final):
            self._files.delete(draft, False)
            raise RuntimeError(f"commit {state['commit']} of {self.path} was made by another writer")

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _rows(self, state: dict, parts: dict[str, list]) -> DataFrame:
        """The rows of the given parts, of each key all since it last began anew."""
        paths = [f"{self.path}/{folder}/bucket={b}" for b, listed in parts.items() for folder, _ in listed]
        schema = state["schema"]
        rows = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        began = F.max(F.when(F.col("fresh"), F.col("commit"))).over(Window.partitionBy(self.key))
        return rows.withColumn("began", began).where(F.col("began").isNull() | (F.col("commit") >= F.col("began")))

    def _folded(self, state: dict, parts: dict[str, list]) -> DataFrame:
        return fold_upserts(self._rows(state, parts), self.key, "commit", F.max("commit").alias("commit"), F.bool_or("fresh").alias("fresh"))

    def _alive(self, rows: DataFrame, cutoff: str | None) -> DataFrame:
        return rows.where(F.col("found_at") >= F.lit(cutoff).cast("timestamp")) if cutoff else rows

    def read(self, commit: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The articles as of a commit, by default the last; of some buckets, if given."""
        state = self.state(commit)
        parts = {b: p for b, p in state["parts"].items() if buckets is None or int(b) in buckets}
        return self._alive(self._folded(state, parts), state["cutoff"]).drop("commit", "fresh")

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The articles of the keys, read from their buckets alone."""
        touched = [r[0] for r in keys.select(self._bucket()).distinct().collect()]
        return self.read(buckets=touched).join(keys.select(self.key).distinct(), self.key, "left_semi")

    def merge(self, batch: DataFrame, source: str = "batch", number: int | None = None, as_of: str | None = None) -> int:
        """Fold a batch of writes into the store; the number of the commit that holds it. as_of: the time that retention counts from; the latest find, if none is given."""
        before = self.state() or {"commit": -1, "buckets": self.buckets, "parts": {}, "sources": {}, "latest": None, "cutoff": None, "schema": None}
        if number is not None and before["sources"].get(source, -1) >= number:
            return before["commit"]
        commit = before["commit"] + 1
        folded = fold_upserts(batch, self.key, self.order).withColumn("bucket", self._bucket()).persist()
        try:
            touched = {str(r["bucket"]): r for r in folded.groupBy("bucket").agg(F.max("found_at").cast("string").alias("latest")).collect()}
            latest = as_of or max((x for x in [before["latest"], *[r["latest"] for r in touched.values()]] if x), default=None)
            state = before | {"commit": commit, "latest": latest, "sources": before["sources"] | ({source: number} if number is not None else {})}
            state["cutoff"] = self._earlier(latest) if latest and self.retain_hours is not None else before["cutoff"]
            rows = folded.withColumn("commit", F.lit(commit).cast("long"))
            known = {b: p for b, p in before["parts"].items() if b in touched}
            if known:
                stored = self._alive(self._rows(before, known).groupBy(self.key).agg(F.min_by("found_at", "commit").alias("found_at")), before["cutoff"])
                known_keys = stored.select(F.col(self.key).alias("__key"), F.lit(True).alias("__there"))
                rows = rows.join(known_keys, F.col(self.key).eqNullSafe(F.col("__key")), "left").withColumn("fresh", F.col("__there").isNull()).drop("__key", "__there")
            else:
                rows = rows.withColumn("fresh", F.lit(True))
            state["schema"] = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("bucket").schema)
            state["parts"] = dict(before["parts"])
            state["added"] = self._write(rows, f"c{commit}") if touched else {}
            for b, part in state["added"].items():
                state["parts"][b] = [*state["parts"].get(b, []), part]
            self._merge_parts(state, touched)
        finally:
            folded.unpersist()
        self._commit(state)
        self._vacuum()
        return commit

    def _earlier(self, at: str) -> str:
        return self.spark.range(1).select((F.lit(at).cast("timestamp") - F.make_dt_interval(hours=F.lit(self.retain_hours))).cast("string")).first()[0]

    def _write(self, rows: DataFrame, name: str) -> dict[str, list]:
        """Write rows by bucket to a folder of their own: [folder, bytes] by bucket."""
        folder = f"{name}-{uuid.uuid4().hex}"
        rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        sizes: dict[str, int] = {}
        found = self._files.listFiles(self._at(folder), True)
        while found.hasNext():
            f = found.next()
            if f.getPath().getName().startswith("part-"):
                bucket = f.getPath().getParent().getName().removeprefix("bucket=")
                sizes[bucket] = sizes.get(bucket, 0) + f.getLen()
        return {b: [folder, size] for b, size in sizes.items()}

    def _merge_parts(self, state: dict, touched) -> None:
        """Merge what is due in the touched buckets, all in one job. Articles that have gone are left out where a whole bucket is merged."""
        due: dict[str, int] = {}
        for b in touched:
            sizes = [size for _, size in state["parts"].get(b, [])]
            begin = next((i for i in range(len(sizes) - 1) if sizes[i] <= sum(sizes[i + 1 :])), None)
            if begin is not None:
                due[b] = begin
        if not due:
            return
        rows = self._folded(state, {b: state["parts"][b][i:] for b, i in due.items()}).withColumn("bucket", self._bucket())
        whole = [int(b) for b, i in due.items() if i == 0]
        if state["cutoff"] and whole:
            rows = rows.where(~F.col("bucket").isin(whole) | (F.col("found_at") >= F.lit(state["cutoff"]).cast("timestamp")))
        written = self._write(rows, f"m{state['commit']}")
        for b, i in due.items():
            state["parts"][b] = [*state["parts"][b][:i], *([written[b]] if b in written else [])]

    def _vacuum(self) -> None:
        """Remove the commits but the last `keep`, and the parts that only they list."""
        commits = self.commits()

        def folders(commit: int) -> set[str]:
            state = self.state(commit)
            return {folder for parts in [*state["parts"].values(), list(state.get("added", {}).values())] for folder, _ in parts}

        if len(commits) > self.keep:
            kept = set().union(*[folders(c) for c in commits[-self.keep :]])
            for old in commits[: -self.keep]:
                for folder in folders(old) - kept:
                    self._files.delete(self._at(folder), True)
                self._files.delete(self._at("_commits", f"{old:0{_DIGITS}}.json"), False)
