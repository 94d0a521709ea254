"""Reading and writing the file kinds of a knowledge-graph package: triple TSV, tables with a header, JSON rows, maps, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.splits import dense_ids
from .store import written

#: Names that wrapped row lists, ids and names come under.
WRAPPERS = ("rows", "data", "examples", "predictions", "prediction", "results")
TYPE_COLUMNS = ("final_type", "type", "raw_type")
HEADS, TAILS = ("head", "source", ":start_id"), ("tail", "target", ":end_id")


def read_triples(spark: SparkSession, path: str, split: str | None = None, sep: str = "\t") -> DataFrame:
    """Headerless head, relation, tail; everything is a string, 'NA' included, and empty fields are empty strings. Rows with a blank field or naming the columns are left out."""
    raw = spark.read.csv(path, schema="head string, relation string, tail string", sep=sep, quote="", header=False)
    clean = raw.select(*[F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in raw.columns])
    out = _edges_only(clean)
    return out.withColumn("split", F.lit(split)) if split else out


def read_id_triples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema="h int, r int, t int", sep="\t")


def encode(triples: DataFrame, entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(encoded h, r, t; triples with an unknown name). entities and relations are (name, id)."""
    h, t = (entities.select(F.col("name").alias(c), F.col("id").alias(i)) for c, i in (("head", "h"), ("tail", "t")))
    r = relations.select(F.col("name").alias("relation"), F.col("id").alias("r"))
    j = triples.join(h, "head", "left").join(r, "relation", "left").join(t, "tail", "left")
    ok = F.col("h").isNotNull() & F.col("r").isNotNull() & F.col("t").isNotNull()
    return j.where(ok).select("h", "r", "t"), j.where(~ok).select("head", "relation", "tail")


def read_rows(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Rows of a JSON array, or of an object that holds the rows under one of WRAPPERS."""
    reader = spark.read.option("multiLine", True)
    df = reader.schema(schema).json(path) if schema else reader.json(path)
    for name in WRAPPERS:
        if name in df.columns and df.schema[name].dataType.typeName() == "array":
            return df.select(F.inline(name))
    return df


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    """Tab where the first line has one, else the commonest of comma, semicolon and bar in it, else tab."""
    line = (spark.read.text(path).head(1) or [[""]])[0][0]
    best = max(",;|", key=line.count)
    return "\t" if "\t" in line or not line.count(best) else best


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A table with a header, its delimiter sniffed, everything as text; empty fields are empty, not null."""
    df = spark.read.csv(path, sep=sniff_delimiter(spark, path), header=True)
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns])


def sample_table(df: DataFrame, n: int, order) -> DataFrame:
    """The first n rows in an order, with the field names and the number of all rows beside each."""
    return df.orderBy(*order).limit(n).crossJoin(df.agg(F.count("*").alias("n_rows"))).withColumn("fields", F.lit(",".join(df.columns)))


def read_edges(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """Edges of a SIF-like file, gzipped or not: rows of fewer than three fields are left out, further fields ignored, fields trimmed, blank ones and a header dropped."""
    parts = F.split("value", sep)
    raw = spark.read.text(path).where(F.size(parts) >= 3).select(*[F.trim(F.get(parts, F.lit(i))).alias(c) for i, c in enumerate(("head", "relation", "tail"))])
    return _edges_only(raw)


def _edges_only(raw: DataFrame) -> DataFrame:
    header = F.lower("head").isin(*HEADS) & F.lower("tail").isin(*TAILS)
    return raw.where("head <> '' and relation <> '' and tail <> ''").where(~header)


def read_free_edges(spark: SparkSession, path: str, relations: list[str]) -> DataFrame:
    """Edges of lines whose relation stands in any of the first three columns (the second, the third, the first are tried in turn), separated by tabs, else by commas; other lines are left out."""
    norm = lambda c: F.regexp_replace(F.lower(F.trim(c)), "[- ]", "_")
    raw = spark.read.text(path).withColumn("p", F.when(F.contains("value", F.lit("\t")), F.split("value", "\t")).otherwise(F.split("value", ","))).where(F.size("p") >= 3)
    c = [F.trim(F.get("p", F.lit(i))) for i in range(3)]
    known = [norm(x).isin(*relations) for x in c]
    pick = lambda i, h, t: F.when(known[i], F.struct(c[h].alias("head"), norm(c[i]).alias("relation"), c[t].alias("tail")))
    return raw.select(F.coalesce(pick(1, 0, 2), pick(2, 0, 1), pick(0, 1, 2)).alias("e")).where("e is not null").select("e.*")


def best_file(spark: SparkSession, path: str, bonus: dict[str, int]) -> DataFrame:
    """The file below a folder whose path has most bonus by the words in it, of equal ones the largest, then the first by name: path, length, score."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    score = sum((F.when(F.lower("path").contains(w), n).otherwise(0) for w, n in bonus.items()), F.lit(0))
    return f.withColumn("score", score).orderBy(F.desc("score"), F.desc("length"), "path").limit(1)


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    """(name, id) of a candidate universe stored as an object of two lists."""
    df = spark.read.option("multiLine", True).schema("names array<string>, ids array<bigint>").json(path)
    return df.select(F.inline(F.arrays_zip(F.col("names").alias("name"), F.col("ids").alias("id"))))


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """variant_name with name and value of each setting in a folder of JSON configurations."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.get_json_object("value", "$.variant_name").alias("variant_name"), F.explode(F.from_json(F.get_json_object("value", "$.params"), "map<string,string>")).alias("name", "value"))


def selected_config(manifest: DataFrame, configs: DataFrame) -> DataFrame:
    """The settings of the variant that a manifest names."""
    return configs.join(F.broadcast(manifest.select(F.col("selected").alias("variant_name"))), "variant_name", "left_semi")


def inverted(relations: DataFrame) -> DataFrame:
    """A dictionary (name, id) read the other way, (id, name); of equal ids the last name."""
    return relations.groupBy("id").agg(F.max("name").alias("name"))


def tables_in(spark: SparkSession, folder: str) -> list[str]:
    """Names of the Parquet tables (files or folders) in a folder that Spark reads, in order."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return sorted(n.removesuffix(".parquet") for n in (f.getPath().getName() for f in found) if n.endswith(".parquet"))


def adjacency(edges: DataFrame) -> DataFrame:
    """(node, relation, neighbour, head, tail): each edge at both of its ends, dealt by node."""
    out = edges.select(F.col("h").alias("node"), F.col("r").alias("relation"), F.col("t").alias("neighbour"), F.col("h").alias("head"), F.col("t").alias("tail"))
    back = edges.where("h <> t").select(F.col("t").alias("node"), F.col("r").alias("relation"), F.col("h").alias("neighbour"), F.col("h").alias("head"), F.col("t").alias("tail"))
    return out.unionByName(back).repartition("node")


def read_nodes(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """node_id, name, kind from a table with a header under any of the usual names; the kind is else what stands before '::'."""
    df = spark.read.csv(path, sep=sep, header=True)
    pick = lambda *names: F.coalesce(*[F.nullif(F.col(f"`{n}`"), F.lit("")) for n in names if n in df.columns], F.lit(None).cast("string"))
    node = pick("id", "node_id", ":ID")
    return df.select(node.alias("node_id"), F.coalesce(pick("name", "label"), node).alias("name"), F.coalesce(pick("kind", "type", ":LABEL"), F.substring_index(node, "::", 1)).alias("kind"))


def read_type_map(spark: SparkSession, path: str, policy: str = "best") -> DataFrame:
    """entity, type. policy: best (final_type, type, raw_type, Unknown), second (the second column whatever its name) or final."""
    df = spark.read.csv(path, sep="\t", header=True)
    if policy == "second":
        return df.select(F.col(df.columns[0]).alias("entity"), F.col(df.columns[1]).alias("type"))
    names = [c for c in TYPE_COLUMNS if c in df.columns][: None if policy == "best" else 1]
    return df.select(F.col(df.columns[0]).alias("entity"), F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in names], F.lit("Unknown")).alias("type"))


def read_map(spark: SparkSession, path: str, key_type: str = "string") -> DataFrame:
    """key, value of a JSON object."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "value")).select(F.col("key").cast(key_type).alias("key"), "value")


def manifest(spark: SparkSession, path: str, hash_bytes: int = 256 << 20) -> DataFrame:
    """path, size, suffix, lines, md5 and sha256 of each file below a folder. Files beyond hash_bytes are listed without lines and hashes, and never read whole."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    listed = f.select("path", F.col("length").alias("size"), F.element_at(F.split("path", r"\."), -1).alias("suffix"))
    lines = F.length("content") - F.length(F.replace(F.decode("content", "ISO-8859-1"), F.lit("\n"), F.lit("")))
    read = f.where(F.col("length") <= hash_bytes).select("path", lines.cast("long").alias("lines"), F.md5("content").alias("md5"), F.sha2("content", 256).alias("sha256"))
    return listed.join(read, "path", "left")


def write_triples(df: DataFrame, path: str, columns=("head", "relation", "tail")) -> None:
    df.select(*columns).write.mode("overwrite").csv(path, sep="\t", header=False, quote="")


def write_table(df: DataFrame, path: str, columns, sep: str = "\t") -> None:
    df.select(*columns).write.mode("overwrite").csv(path, sep=sep, header=True)


def write_rows(df: DataFrame, path: str) -> None:
    """JSON lines."""
    df.write.mode("overwrite").json(path)


def _in_lines(df: DataFrame, path: str, order, line, head: str, tail: str, later: dict[int, str] | None = None) -> None:
    """Text files that make up one JSON value in the order of their names: head, a line for each row (a comma before all but the first, or what `later` has for its number), tail. Rows are numbered in their order by ranges; no task has more than a range."""
    spark = df.sparkSession
    keyed = df.select(F.struct(*[F.col(c) if isinstance(c, str) else c for c in order], line.alias("_line"), F.monotonically_increasing_id().alias("_row")).alias("_by"))
    rows = dense_ids(keyed, "_by", "_n").select("_n", F.concat(*[F.coalesce(*[F.when(F.col("_n") == n, F.lit(x)) for n, x in ((later or {}) | {0: head}).items()], F.lit(","))], "_by._line").alias("value"))
    end = spark.createDataFrame([("",)], "x string").crossJoin(df.agg(F.count("*").alias("_n"))).select(F.col("_n"), F.when(F.col("_n") == 0, F.lit(head + tail)).otherwise(F.lit(tail)).alias("value"))
    rows.unionByName(end).repartitionByRange("_n").sortWithinPartitions("_n").select("value").write.mode("overwrite").text(path)


def write_array(df: DataFrame, path: str, order, wrapper: str | None = None) -> None:
    """One JSON array, as other tools read it, or with `wrapper` an object that holds it under that name: a folder of files, which one after another (cat part-*) are the value, an object a line. Any number of rows."""
    head, tail = ("[", "]") if wrapper is None else (f'{{"{wrapper}": [', "]}")
    _in_lines(df, path, order, F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}), head, tail)


def write_universe(df: DataFrame, path: str) -> None:
    """A candidate universe (name, id), not empty, as one JSON object of two lists in the order of ids, an entry a line, by files as write_array."""
    name = F.regexp_extract(F.to_json(F.struct(F.col("name").alias("k"))), r'(?s)^\{"k":(.*)\}$', 1)
    both = df.select(F.lit(0).alias("part"), "id", name.alias("line")).unionByName(df.select(F.lit(1).alias("part"), "id", F.col("id").cast("string").alias("line")))
    _in_lines(both, path, ["part", "id"], F.col("line"), '{"names": [', "]}", {df.count(): '], "ids": ['})


def read_universe_lines(spark: SparkSession, path: str) -> DataFrame:
    """(name, id) of a universe as write_universe lays it out: lines are numbered in the order of files and of places in them, and the n-th name meets the n-th id."""
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))
    lines = written(dense_ids(spark.read.text(path).where("value <> ''").select(at.alias("at"), "value"), "at", "n").select("n", "value"), "universe-lines")
    middle = lines.where(F.col("value").startswith('], "ids": [')).agg(F.min("n").alias("middle"))
    lines = lines.where("value <> ']}'").crossJoin(F.broadcast(middle)).withColumn("value", F.regexp_replace("value", r'^(\{"names": \[|\], "ids": \[|,)', ""))
    names = lines.where("n < middle").select("n", F.get_json_object(F.concat(F.lit('{"k":'), "value", F.lit("}")), "$.k").alias("name"))
    return names.join(lines.where("n >= middle").select((F.col("n") - F.col("middle")).alias("n"), F.col("value").cast("long").alias("id")), "n").select("name", "id")


def write_json_map(df: DataFrame, path: str) -> None:
    """A map (key, value) as one JSON object in the order of keys, a pair a line, by files as write_array."""
    key = F.regexp_extract(F.to_json(F.struct(F.col("key").cast("string").alias("k"))), r'(?s)^\{"k":(.*)\}$', 1)
    value = F.regexp_extract(F.to_json(F.struct(F.col("value").alias("v")), {"ignoreNullFields": "false"}), r'(?s)^\{"v":(.*)\}$', 1)
    _in_lines(df, path, ["key"], F.concat(key, F.lit(": "), value), "{", "}")


def read_lines(spark: SparkSession, path: str, schema: str, found: DataFrame | None = None) -> DataFrame:
    """Rows of a JSON array, or of an object that holds them, with an object a line, as write_array and most writers lay it out. Lines are read apart, so files of any size are; a line of the frame is no object and left out."""
    line = F.regexp_replace(F.regexp_replace(F.trim("value"), r'^(\{\s*"[^"]*"\s*:\s*\[|\[|,)\s*', ""), r"\s*(,|\]\s*\}?)$", "")
    text = spark.read.text(path) if found is None else found
    return text.select(line.alias("value")).where(F.col("value").startswith("{") & F.col("value").endswith("}")).select(F.from_json("value", schema).alias("x")).select("x.*")


def read_map_lines(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of a JSON object with a pair a line; values as text."""
    line = F.regexp_replace(F.regexp_replace(F.trim("value"), r"^[{,]\s*", ""), r"\s*[,}]$", "")
    pair = F.from_json(F.concat(F.lit("{"), line, F.lit("}")), "map<string,string>")
    return spark.read.text(path).where(line != "").select(F.explode(pair).alias("key", "value"))


def sniffed(spark: SparkSession, path: str) -> DataFrame:
    """(file, sep, n_lines) of every file below a folder: the delimiter of its first line, by the rule of sniff_delimiter. Files are read as lines, many at a time; each gives one row."""
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("row")).alias("by"), "value")
    first = lines.groupBy("file").agg(F.min_by("value", "by").alias("first"), F.count("*").alias("n_lines"))
    n = lambda c: F.length("first") - F.length(F.replace("first", F.lit(c), F.lit("")))
    most = F.greatest(n(","), n(";"), n("|"))
    sep = F.when(F.contains("first", F.lit("\t")) | (most == 0), F.lit("\t")).when(n(",") == most, F.lit(",")).when(n(";") == most, F.lit(";")).otherwise(F.lit("|"))
    return first.select("file", sep.alias("sep"), "n_lines")


def write_object(df: DataFrame, path: str) -> None:
    """The one row of df as a JSON object."""
    df.limit(1).select(F.to_json(F.struct(*df.columns)).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_map(df: DataFrame, path: str) -> None:
    """A map (key, value), as Parquet with its types."""
    df.select("key", "value").write.mode("overwrite").parquet(path)


def copy_files(spark: SparkSession, source: str, target: str, names: list[str]) -> list[str]:
    """Copies those of the named files that a folder has, by the file system of the paths; returns their names."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join(parts))
    fs_in, fs_out = at(source).getFileSystem(conf), at(target).getFileSystem(conf)
    fs_out.mkdirs(at(target))
    found = [n for n in names if fs_in.exists(at(source, n))]
    for n in found:
        jvm.org.apache.hadoop.fs.FileUtil.copy(fs_in, at(source, n), fs_out, at(target, n), False, True, conf)
    return found


def write_predictions(df: DataFrame, metrics: DataFrame, path: str) -> None:
    """Predictions as JSON lines, metrics as an object, and the same metrics as text lines 'name: value'."""
    write_rows(df, f"{path}/predictions")
    write_object(metrics, f"{path}/metrics")
    lines = F.array(*[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in metrics.columns])
    metrics.limit(1).select(F.explode(lines).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/metrics_text")


def extract(archive: str, target: str) -> list[str]:
    """Unpacks a zip or tar archive on the driver. An entry whose path leaves the target folder is an error, before anything is written; links are left out."""
    import tarfile
    import zipfile
    from pathlib import Path

    root = Path(target).resolve()
    if zipfile.is_zipfile(archive):
        with zipfile.ZipFile(archive) as z:
            names = z.namelist()
            _inside(root, names)
            z.extractall(root)
        return names
    with tarfile.open(archive) as t:
        members = [m for m in t.getmembers() if m.isfile() or m.isdir()]
        _inside(root, [m.name for m in members])
        t.extractall(root, members=members, filter="data")
        return [m.name for m in members]


def _inside(root, names) -> None:
    for n in names:
        if not (root / n).resolve().is_relative_to(root):
            raise ValueError(f"{n} leaves the folder")


def write_package(df: DataFrame, path: str) -> None:
    """One folder for each split, as Parquet."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new in place of those with the same key."""
    return old.join(new.select(key), key, "left_anti").select(*new.columns).unionByName(new)


def markdown(df: DataFrame) -> DataFrame:
    """One column of table rows, cells escaped; the header is in its name-free first row (n = 0)."""
    cell = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))
    body = df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in df.columns]), F.lit(" |")).alias("line"))
    head = df.sparkSession.createDataFrame([(0, "| " + " | ".join(df.columns) + " |"), (1, "|" + "---|" * len(df.columns))], "n int, line string")
    return head.unionByName(body.select(F.lit(2).alias("n"), "line"))


def latex(df: DataFrame, order) -> DataFrame:
    """Lines (n, line) of a LaTeX table: header, a row for each row of df in an order, rules around them; special characters escaped."""
    def cell(c: str):
        return F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"([&%$#_{}])", r"\\$1")

    from pyspark.sql import Window

    body = df.withColumn("n", F.row_number().over(Window.orderBy(*order)) + 2).select("n", F.concat(F.concat_ws(" & ", *[cell(c) for c in df.columns]), F.lit(r" \\")).alias("line"))
    plain = lambda x: "".join("\\" + ch if ch in "&%$#_{}" else ch for ch in x)
    spark = df.sparkSession
    head = spark.createDataFrame([(0, r"\begin{tabular}{" + "l" * len(df.columns) + "}"), (1, r"\toprule"), (2, " & ".join(map(plain, df.columns)) + r" \\")], "n int, line string")
    end = spark.createDataFrame([(2**31 - 2, r"\bottomrule"), (2**31 - 1, r"\end{tabular}")], "n int, line string")
    return head.unionByName(body).unionByName(end)


def case_report(df: DataFrame, title: str, fields) -> DataFrame:
    """(n, line) of a report: a heading for each row of df (its column n, from 0) and a line for each field; a null field is n/a."""
    lines = [F.concat(F.lit("## "), F.col(title))] + [F.concat(F.lit(f"- {c}: "), F.coalesce(F.col(c).cast("string"), F.lit("n/a"))) for c in fields]
    return df.select(F.col("n").alias("case"), F.posexplode(F.array(*lines)).alias("at", "line")).select((F.col("case") * len(lines) + F.col("at")).alias("n"), "line")
