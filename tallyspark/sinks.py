"""Canonical CSV, consolidated CSV, JSON reports and the HTML report."""

from __future__ import annotations

import html
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.amounts import money_text
from .functions.paths import file_name
from .model import STANDARD_COLUMNS
from .operators import monthly, stats
from .operators.graph import materialise, release


def formatted(txns: DataFrame, more: list | None = None) -> DataFrame:
    """STANDARD_COLUMNS as text: ISO dates, empty for null; accounts without name are named by themselves, of type
    debit. more: columns that are kept beside them."""
    have = lambda c: F.col(c) if c in txns.columns else F.lit(None)
    full = txns.withColumns({"account_name": F.coalesce(have("account_name"), "account"), "account_type": F.coalesce(have("account_type"), F.lit("debit"))})
    return full.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in STANDARD_COLUMNS], *(more or []))


def _place(source_file: Column, institution: Column) -> dict[str, Column]:
    """Folders of a source file's rows: the institution, and the file's name with a digest of its path (two folders may have an a.qfx)."""
    return {"inst": F.replace(F.lower(institution), F.lit(" "), F.lit("_")), "file": F.concat(file_name(source_file), F.lit("."), F.substring(F.md5(source_file), 1, 8), F.lit(".csv"))}


def output_path(source_file: Column, institution: Column) -> Column:
    """Where write_canonical puts a file's rows, below its folder."""
    return F.concat_ws("/", *[F.concat(F.lit(f"__{k}="), c) for k, c in _place(source_file, institution).items()])


def write_canonical(txns: DataFrame, folder: str) -> None:
    """One folder per institution and source file, rows in input order. A file's folder is replaced, others stay as they are."""
    rows = formatted(txns, ["txn_seq", *[c.alias(f"__{k}") for k, c in _place(F.col("source_file"), F.col("institution")).items()]])
    dealt = rows.repartition("__inst", "__file").sortWithinPartitions("__inst", "__file", "txn_seq").drop("txn_seq")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("header", True).partitionBy("__inst", "__file").csv(folder)


def written(spark: SparkSession, folder: str) -> DataFrame:
    """(output_file) of the folders that write_canonical has filled; none if there is no such folder."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "output_file string")
    return files.select(F.regexp_extract("path", r"(__inst=[^/]+/__file=[^/]+)/", 1).alias("output_file")).where("output_file <> ''").distinct()


def write_consolidated(txns: DataFrame, path: str, one_file: str | None = None) -> None:
    """The export in order of date, then input: CSV parts that are ranged by it, in the order of their names, and a manifest (in `_manifest`, JSON: part, first and
    last date, rows). one_file: where a single file of all parts is put too, copied part by part."""
    order = ["date", "txn_seq"]
    n = int(txns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    table = materialise(txns)  # ranging looks at its input twice
    ranged = formatted(table.repartitionByRange(n, *order).sortWithinPartitions(*order))
    ranged.write.mode("overwrite").option("header", True).csv(path)
    release(table)
    spark = txns.sparkSession
    parts = spark.read.schema(", ".join(f"`{c}` string" for c in STANDARD_COLUMNS)).option("header", True).option("multiLine", True).csv(path)
    about = parts.groupBy(file_name(F.col("_metadata.file_path")).alias("part")).agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count("*").alias("rows"))
    manifest = about.orderBy("part").collect()  # a row per task
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    file = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    system = file(path).getFileSystem(conf)
    out = system.create(file(f"{path}/_manifest/parts.json"), True)
    out.write(bytearray("".join(json.dumps(r.asDict()) + "\n" for r in manifest).encode()))
    out.close()
    if one_file:
        header = (",".join(STANDARD_COLUMNS) + "\n").encode()
        out = file(one_file).getFileSystem(conf).create(file(one_file), True)
        out.write(bytearray(header))
        for r in manifest:
            part = system.open(file(f"{path}/{r['part']}"))
            part.seek(len(header))
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 20, False)
            part.close()
        out.close()


def write_total(txns: DataFrame, folder: str) -> None:
    """The total with source_file, and its summary as JSON."""
    write = lambda df: df.select(*[F.col(c).cast("string") for c in STANDARD_COLUMNS if c in df.columns], "source_file").write.mode("overwrite").option("header", True).csv(f"{folder}/all_transactions")
    stats.summarised(txns, write).write.mode("overwrite").json(f"{folder}/summary")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def html_report(txns: DataFrame, title: str = "Monthly summary", rows: int = 200, details: str | None = None) -> str:
    """Years, months and a grand total of rows net of pairs, and below each cell the first of the rows that make it up (a pair is one
    flagged row). The table has a row per month of the data, whatever their number; of a cell the page shows `rows` rows, how many there
    are, and where all are: in details, a folder that is written with them if given."""
    flat = materialise(monthly.drill_rows(txns))
    if details:
        flat.repartitionByRange("month", "bucket", "nth").sortWithinPartitions("month", "bucket", "nth").write.mode("overwrite").option("header", True).csv(details)
    table = monthly.rolled(flat).orderBy(F.desc_nulls_last("year"), F.desc_nulls_first("month"))
    text = table.select("year", "month", "level", *[money_text(F.col(c)).alias(c) for c in [*monthly.BUCKETS, "net"]]).collect()
    item = F.struct("nth", F.col("date").cast("string").alias("date"), F.col("amount").cast("string").alias("amount"), "description", "account_name", "institution", "is_pair")
    cell = flat.groupBy("month", "bucket").agg(F.count("*").alias("n"), F.to_json(F.array_sort(F.collect_list(F.when(F.col("nth") <= rows, item)))).alias("rows")).collect()
    data = {f"{r['month']} {r['bucket']}": {"n": r["n"], "rows": json.loads(r["rows"])} for r in cell}
    names = [*monthly.BUCKETS, "net"]
    head = "".join(f"<th>{html.escape(n.replace('_', ' '))}</th>" for n in names)
    kinds = {0: "month", 1: "year", 3: "total"}
    body = "".join(
        f"<tr class={kinds[r['level']]}><th>{html.escape(r['month'] or r['year'] or 'Total')}</th>" + "".join(f"<td data-key='{html.escape(f'{r['month']} {n}')}'>{html.escape(r[n])}</td>" for n in names) + "</tr>" for r in text
    )
    script = "document.querySelectorAll('td').forEach(t=>t.onclick=()=>{const d=DATA[t.dataset.key];if(d)document.getElementById('rows').textContent=d.n+' rows'+(d.n>d.rows.length?', the first '+d.rows.length+' of them; all: '+DETAILS:'')+'\\n'+d.rows.map(r=>[(r.is_pair?'pair ':'')+r.date,r.amount,r.description,r.account_name,r.institution].join(' | ')).join('\\n')})"
    embedded = json.dumps(data).replace("</", "<\\/")
    return f"<!DOCTYPE html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><table><tr><th></th>{head}</tr>{body}</table><pre id=rows></pre><script>const DATA={embedded},DETAILS={json.dumps(details or "not written").replace("</", "<\\/")};{script}</script>"
