"""A saved capture: one Parquet table per entity, read only as far as it is asked for."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = [
    "links", "pages", "refs", "observations", "endpoints", "contract_fields", "contract_bodies", "endpoint_response",
    "patterns", "params", "net_calls", "edges", "stats", "meta", "archive",
]
#: Rows of a table are put in this order before they are written, so that equal and similar values are neighbours.
CLUSTER = {
    "links": ["resolved", "href"], "edges": ["kind", "from_key", "to_key"], "pages": ["url"], "refs": ["source_url", "offset"],
    "observations": ["url"], "endpoints": ["path"], "contract_fields": ["path"], "patterns": ["domain", "pattern"],
}
MANIFEST = "capture.json"


def hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm


@dataclass
class Snapshot:
    """Tables by name; each is a lazy DataFrame."""

    tables: dict[str, DataFrame] = field(default_factory=dict)

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def __contains__(self, name: str) -> bool:
        return name in self.tables

    def save(self, path: str, compression: str = "zstd") -> None:
        """Write all tables beside ``path`` and put them there by a rename.

        Works on any file system that Spark reaches.
        """
        spark = next(iter(self.tables.values())).sparkSession
        side = f"{path.rstrip('/')}.writing"
        there, fs, jvm = hadoop_path(spark, path)
        aside = jvm.org.apache.hadoop.fs.Path(side)
        fs.delete(aside, True)
        for name, df in self.tables.items():
            keys = [c for c in CLUSTER.get(name, []) if c in df.columns]
            ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys) if keys else df
            writer = ordered.write.option("compression", compression)
            writer.option("parquet.writer.version", "v2").parquet(f"{side}/{name}")
        out = fs.create(jvm.org.apache.hadoop.fs.Path(f"{side}/{MANIFEST}"), True)
        out.write(bytearray(json.dumps({"version": 1, "tables": sorted(self.tables)}), "utf-8"))
        out.close()
        fs.delete(there, True)
        if not fs.rename(aside, there):
            raise OSError(f"could not move {side} to {path}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Snapshot:
        """The tables of a saved capture; nothing is read but schemas."""
        p, fs, jvm = hadoop_path(spark, f"{path.rstrip('/')}/{MANIFEST}")
        if not fs.exists(p):
            raise ValueError(f"{path} is not a saved capture")
        text = spark.read.text(f"{path.rstrip('/')}/{MANIFEST}", wholetext=True).first()[0]
        return cls({n: spark.read.parquet(f"{path.rstrip('/')}/{n}") for n in json.loads(text)["tables"]})

    def to_json(self) -> dict[str, DataFrame]:
        """Each table as JSON lines (column json)."""
        return {n: df.select(F.to_json(F.struct("*")).alias("json")) for n, df in self.tables.items()}

    def layout(self) -> DataFrame:
        """(table, rows) of every table."""
        counts = [df.agg(F.lit(n).alias("table"), F.count(F.lit(1)).alias("rows")) for n, df in self.tables.items()]
        out = counts[0]
        for c in counts[1:]:
            out = out.union(c)
        return out


def capture_meta(spark: SparkSession, options: dict[str, str], headers: list[str] = ()) -> DataFrame:
    """(key, value) of a capture's metadata; of request headers only the names are kept."""
    rows = [(k, str(v)) for k, v in sorted(options.items())]
    names = sorted({h.partition(":")[0].strip() for h in headers if ":" in h})
    if names:
        rows.append(("header_names", ",".join(names)))
    return spark.createDataFrame(rows, "key string, value string")


# Flags whose value is a credential.
SECRET_FLAGS = {"-H", "-b", "-cookie", "--cookie", "--header"}


def masked_command(args: list[str]) -> str:
    """A command line with the values of credential flags masked."""
    out, hide = [], False
    for a in args:
        flag, eq, _ = a.partition("=")
        if hide:
            out.append("***")
            hide = False
        elif flag in SECRET_FLAGS and eq:
            out.append(f"{flag}=***")
        else:
            hide = a in SECRET_FLAGS
            out.append(a)
    return " ".join(out)


def archive_name(c):
    """A file name for a URL: host and path, with other characters as underscores."""
    from siteatlas.functions import url

    plain = F.regexp_replace(F.concat(url.host(c), url.raw_path(c)), r"[^A-Za-z0-9._\-/]", "_")
    parts = F.filter(F.split(plain, "/", -1), lambda p: ~p.isin("", ".", ".."))
    name = F.array_join(parts, "/")
    return F.when(name == "", "index").otherwise(name)


def planned_names(entries: DataFrame) -> DataFrame:
    """Entries (name, data) with a number before the extension of names that repeat."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("name").orderBy("data"))
    stem, ext = F.regexp_extract("name", r"^(.*?)(\.[^./]*)?$", 1), F.regexp_extract("name", r"(\.[^./]*)$", 1)
    return entries.withColumn("n", nth).withColumn(
        "name", F.when(F.col("n") == 1, F.col("name")).otherwise(F.concat(stem, F.lit("-"), F.col("n").cast("string"), ext))
    ).drop("n")


def put_entries(archive: DataFrame, entries: DataFrame) -> DataFrame:
    """An archive with entries added; an entry of a name that is there replaces it."""
    return archive.join(entries.select("name").distinct(), "name", "left_anti").unionByName(entries)


def drop_entry(archive: DataFrame, name: str) -> DataFrame:
    return archive.where(F.col("name") != name)


def write_archive(entries: DataFrame, path: str, kind: str = "tar.gz") -> None:
    """Entries as a tar, tar.gz or zip file on the driver, streamed partition by partition."""
    import io
    import tarfile
    import zipfile

    rows = planned_names(entries).orderBy("name").toLocalIterator()
    if kind == "zip":
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for r in rows:
                z.writestr(r["name"], bytes(r["data"]))
        return
    with tarfile.open(path, "w:gz" if kind == "tar.gz" else "w") as t:
        for r in rows:
            info = tarfile.TarInfo(r["name"])
            info.size = len(r["data"])
            t.addfile(info, io.BytesIO(bytes(r["data"])))


def reference_files(refs: DataFrame) -> DataFrame:
    """(name, data): a text file for each document: a line of place, target and context for each reference."""
    line = F.concat_ws("\t", F.concat_ws(":", "line", "column"), F.col("offset").cast("string"), "target", "snippet")
    rows = refs.withColumn("l", line).groupBy("source_url").agg(F.array_sort(F.collect_list(F.struct("offset", "l"))).alias("ls"))
    text = F.concat(F.lit("# "), F.col("source_url"), F.lit("\n"), F.array_join(F.transform("ls", lambda x: x["l"]), "\n"))
    return rows.select(F.concat(archive_name(F.col("source_url")), F.lit(".ref")).alias("name"), F.encode(text, "UTF-8").alias("data"))


def parsed_reference_files(files: DataFrame) -> DataFrame:
    """References back from their files."""
    lines = F.split(F.decode("data", "UTF-8"), "\n", -1)
    source = F.regexp_replace(F.get(lines, F.lit(0)), "^# ", "")
    rows = files.select(source.alias("source_url"), F.explode(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))).alias("l"))
    p = F.split("l", "\t", -1)
    at = F.split(F.get(p, F.lit(0)), ":", -1)
    return rows.select(
        "source_url",
        F.get(p, F.lit(2)).alias("target"),
        F.get(p, F.lit(1)).cast("long").alias("offset"),
        F.get(at, F.lit(0)).cast("long").alias("line"),
        F.get(at, F.lit(1)).cast("long").alias("column"),
        F.get(p, F.lit(3)).alias("snippet"),
    )
