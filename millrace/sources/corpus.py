"""A corpus on disk: a manifest of routes, Markdown files, and the index tables that are made of them."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexicon import FIELD_WEIGHTS
from ..operators import lexical, sections
from ..operators.assemble import canonical_url
from .versions import Snapshot, Versions

_ENTRY = "struct<title:string,description:string,category:string,url:string>"
MANIFEST = f"version string, generated string, total int, base_url string, routes map<string,{_ENTRY}>"
QUERIES = "id string, query string, language string, product string, topic string, expected_routes array<string>, acceptable_routes array<string>"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(route, ordinal, title, description, category, url): a manifest's routes in its order; a broken file fails."""
    raw = spark.read.schema(MANIFEST).option("multiLine", True).option("mode", "FAILFAST").json(path)
    rows = raw.select(F.posexplode(F.map_entries("routes")).alias("ordinal", "e"))
    return rows.select(F.col("e.key").alias("route"), F.col("ordinal").cast("long").alias("ordinal"), "e.value.title", "e.value.description", "e.value.category", "e.value.url")


def url_map(spark: SparkSession, path: str) -> DataFrame:
    """(name, url) of a JSON object of strings."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>", {"mode": "FAILFAST"}).alias("m"))
    return raw.select(F.explode("m").alias("name", "url"))


def markdown(spark: SparkSession, folder: str) -> DataFrame:
    """(route, body) of every .md file under a folder; the route is the path below it, without the ending."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    plain = "/" + folder.split("://")[-1].strip("/") + "/"
    route = F.regexp_replace(F.substring_index(F.col("_metadata.file_path"), plain, -1), r"\.md$", "")
    return files.select(F.url_decode(route).alias("route"), sections.front_matter(F.col("value"))["body"].alias("body"))


def documents(routes: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Routes with their bodies, and routes whose file is missing."""
    return routes.join(files, "route"), routes.join(files.select("route"), "route", "left_anti")


def write_index(docs: DataFrame, folder: str, base_url: str, source_sha: str = "unknown", stem: bool = True) -> dict[str, int]:
    """Write the tables chunks, code_blocks, routes, graph, meta and the postings of docs under a folder; returns counts.

    Every table is written from the one before, so a lost executor costs its tasks only, and later ones read Parquet.
    """
    spark = docs.sparkSession

    def save(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    routes = save(docs.select("route", "title", "description", "category", canonical_url(F.col("route"), base_url).alias("url"), F.col("url").alias("raw_url")), "routes")
    chunks = save(sections.chunk_docs(docs.select("route", "ordinal", "title", "description", "category", "body")).repartitionByRange("route", "chunk_index").sortWithinPartitions("route", "chunk_index"), "chunks")
    blocks = save(chunks.select("chunk_id", F.explode("code_blocks").alias("b")).select("chunk_id", "b.*"), "code_blocks")
    save(sections.link_graph(chunks), "graph")
    lexical.build(chunks, FIELD_WEIGHTS, stem).write(folder)
    counts = {"n_docs": routes.count(), "n_chunks": chunks.count(), "n_code_blocks": blocks.count()}
    meta = {"schema_version": "1", "source_sha": source_sha, **{k: str(v) for k, v in counts.items()}}
    save(spark.createDataFrame(list(meta.items()), "key string, value string").unionByName(spark.range(1).select(F.lit("built_at").alias("key"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("value"))), "meta")
    return counts


def publish_index(docs: DataFrame, folder: str, base_url: str, source_sha: str = "unknown", stem: bool = True) -> Snapshot:
    """write_index() into a new version under folder, which counts only once all its tables are there."""
    return Versions(docs.sparkSession, folder).publish(lambda aside: write_index(docs, aside, base_url, source_sha, stem))


def fingerprint(spark: SparkSession, path: str) -> str:
    """Of a table's files: their names, sizes and times, so that a change of any file changes it."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(at, True)
    said = []
    while files.hasNext():
        f = files.next()
        said.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(said)).encode()).hexdigest()


def meta_value(spark: SparkSession, folder: str, key: str) -> str | None:
    rows = spark.read.parquet(f"{folder}/meta").filter(F.col("key") == key).limit(1).collect()
    return rows[0].value if rows else None


def eval_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, said, problem, and the QUERIES columns) of each line of JSON-lines query sets that isn't blank.

    problem is null for a line that fits, else what is wrong with it first: not JSON, id, query, or expected_routes.
    """
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("line", "said"))
    kept = texts.filter(F.trim("said") != "").withColumn("line", F.col("line") + 1)
    read = kept.withColumn("q", F.from_json("said", f"{QUERIES}, __bad string", {"columnNameOfCorruptRecord": "__bad"}))
    ok = lambda c: F.coalesce(c, F.lit(False))
    problem = (
        F.when(F.col("q").isNull() | F.col("q.__bad").isNotNull(), "not JSON").when(~ok(F.col("q.id").rlike(r"^q\d{3}$")), "id")
        .when(~ok(F.length("q.query").between(3, 256)), "query").when(~ok(F.size("q.expected_routes") >= 1), "expected_routes")
    )
    return read.withColumn("problem", problem).select("file", "line", "said", "problem", *[f"q.{c.split()[0]}" for c in QUERIES.split(", ")])


def eval_queries(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """The queries of JSON-lines sets. strict: a line that doesn't fit fails the read; else such lines are left out, and
    broken_queries() has them."""
    rows = eval_lines(spark, path)
    if strict:
        said = F.concat(F.lit("a query doesn't fit: "), "file", F.lit(" line "), F.col("line").cast("string"), F.lit(", "), "problem")
        rows = rows.withColumn("query", F.when(F.col("problem").isNotNull(), F.raise_error(said).cast("string")).otherwise(F.col("query")))
    else:
        rows = rows.filter("problem is null")
    return rows.drop("file", "line", "said", "problem").withColumnRenamed("id", "query_id")


def broken_queries(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, problem, said) of the lines of query sets that don't fit."""
    return eval_lines(spark, path).filter("problem is not null").select("file", "line", "problem", "said")


# Files that declare an SDK, in the order they are asked, and what in them says so.
SDK_FILES = (
    ("package.json", "node", r'"<brand>"\s*:'), ("requirements.txt", "python", r"(?i)(?:^|\n)\s*<brand>\b"), ("pyproject.toml", "python", r"\b<brand>\b"),
    ("Pipfile", "python", r"(?i)\b<brand>\b"), ("composer.json", "php", r'"<brand>/<brand>"'), ("Gemfile", "ruby", "(?:^|\\n)\\s*gem\\s+[\"']<brand>[\"']"),
    ("go.mod", "go", r"(?i)<brand>/<brand>-go"), ("pom.xml", "java", r"<groupId>com\.<brand></groupId>"), ("build.gradle", "java", r"com\.<brand>"),
    ("build.gradle.kts", "kotlin", r"com\.<brand>"),
)
MAX_DEPTH, MAX_MANIFEST = 6, 1_000_000


def sdk_language(files: DataFrame, brand: str = "acme") -> DataFrame:
    """(project, language) of (project, depth, file, content): the first probe that fits in the nearest folder.

    depth counts folders upwards from the project's own, 0; beyond MAX_DEPTH and for larger files nothing is read.
    """
    from ..functions.text import rx

    probe = F.lit(None).cast("struct<i:int,lang:string>")
    for i, (name, lang, p) in reversed(list(enumerate(SDK_FILES))):
        fits = (F.col("file") == name) & F.col("content").rlike(rx(p.replace("<brand>", brand)))
        probe = F.when(fits, F.struct(F.lit(i).alias("i"), F.lit(lang).alias("lang"))).otherwise(probe)
    small = files.filter((F.col("depth") < MAX_DEPTH) & (F.octet_length("content") <= MAX_MANIFEST)).withColumn("p", probe).filter("p is not null")
    found = small.groupBy("project").agg(F.min(F.struct("depth", "p.i", "p.lang")).alias("m")).select("project", F.col("m.lang").alias("language"))
    return files.select("project").distinct().join(found, "project", "left")
