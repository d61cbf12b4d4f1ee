"""Readers and writers: whole tables written and read again."""

from __future__ import annotations

import gzip
import http.server
import io
import os
import tempfile
import threading
import zipfile

from pyspark.sql import functions as F

from lexispark.plans.fixtures import PARSE, parsed, rows_sql
from lexispark.plans.registry import query, table
from lexispark.shared import scratch
from lexispark.sources import files


@query("SELECT unnest(string_split(regexp_replace(text, '\\r\\n|\\r', chr(10), 'g'), chr(10))) AS text FROM documents")
def text_files(spark, sf_dir):
    """Texts with breaks are several lines."""
    path = scratch(spark)
    files.write_text(table(spark, sf_dir, "documents"), path, compression="gzip")
    return files.read_text(spark, path, lines=True)


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts, user_id, value FROM events")
def json_line_files(spark, sf_dir):
    path = scratch(spark)
    files.write_json(table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value"), path)
    return files.read_json(spark, path, lines=True, schema="event_id long, ts string, user_id long, value double")


@query("""SELECT o_orderkey, '{"o_orderdate":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '","o_orderkey":' || o_orderkey || ',"o_orderpriority":"' || o_orderpriority || '"}' AS document FROM orders""")
def json_documents(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate")
    return orders.select("o_orderkey", files.to_json_document(orders, sort_keys=True).alias("document"))


@query("""SELECT unnest(['{"key": ' || c_custkey || '}', '[' || c_nationkey || ', null]', '"' || c_name || '"']) AS value FROM customer""")
def json_without_delimiters(spark, sf_dir):
    path = scratch(spark)
    one = F.concat(F.lit('{"key":'), "c_custkey", F.lit("}["), "c_nationkey", F.lit(',null] "'), "c_name", F.lit('"'))
    files.write_text(table(spark, sf_dir, "customer").select(one.alias("text")), path)
    return files.read_json_mash(spark, path)


@query("SELECT item_id::DOUBLE AS item_id, text || ', \"' || item_id || '\"' AS text FROM benchmark")
def csv_files(spark, sf_dir):
    path = scratch(spark)
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.concat("text", F.lit(', "'), F.col("item_id").cast("string"), F.lit('"')).alias("text"))
    files.write_csv(rows, path, delimiter="\t")
    return files.read_csv(spark, path, fieldnames=["item_id", "text"], dialect="excel-tab")


@query("SELECT s_suppkey AS row, s_nationkey::BIGINT AS col, s_acctbal AS value, kind FROM supplier, (SELECT unnest(['npz', 'parquet']) AS kind)")
def sparse_matrix_files(spark, sf_dir):
    """As one file of compressed sparse rows and as Parquet."""
    cells = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("row"), F.col("s_nationkey").cast("long").alias("col"), F.col("s_acctbal").alias("value"))
    one, many = scratch(spark) + ".npz", scratch(spark)
    files.write_sparse_matrix(cells, one, npz=True)
    files.write_sparse_matrix(cells, many)
    return files.read_sparse_matrix(spark, one).withColumn("kind", F.lit("npz")).unionByName(spark.read.parquet(many).withColumn("kind", F.lit("parquet")))


@query(rows_sql("i, text, pos, lemma", *[(i, x[0], x[1], x[4]) for i, x in enumerate(PARSE)]))
def annotated_document_files(spark, sf_dir):
    path = scratch(spark)
    files.write_docs(parsed(spark, sf_dir), path, attrs=["pos", "lemma"])
    return files.read_docs(spark, path).select("item_id", F.posexplode("tokens").alias("i", "t")).select("item_id", "i", "t.text", "t.pos", "t.lemma")


class _Nations(http.server.BaseHTTPRequestHandler):
    lines: tuple[bytes, ...] = ()

    def do_GET(self) -> None:  # noqa: N802
        self.send_response(200)
        self.end_headers()
        self.wfile.write(b"\n\n".join(self.lines) + b"\n")

    def log_message(self, *args) -> None:
        pass


@query("SELECT n_nationkey || ' ' || n_name AS line, way FROM nation, (SELECT unnest(['read', 'written', 'downloaded']) AS way)")
def http_streams(spark, sf_dir):
    """Twenty-five rows served by this process, fetched by the driver in three ways; blank lines don't count."""
    served = tuple(f"{r['n_nationkey']} {r['n_name']}".encode() for r in table(spark, sf_dir, "nation").collect())  # nations
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), type("Served", (_Nations,), {"lines": served}))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/data/nations%20all.txt?x=1"
    with tempfile.TemporaryDirectory() as folder:  # of the driver alone
        try:
            found = {"read": list(files.read_http_stream(url, lines=True))}
            written = files.write_http_stream(url, os.path.join(folder, "a", "n.txt"), make_dirs=True)
            downloaded = files.download_file(url, dirpath=folder)
            again = files.download_file(url, dirpath=folder)
        finally:
            server.shutdown()
            server.server_close()
        if again is not None or os.path.basename(downloaded) != files.filename_from_url(url):
            raise RuntimeError("a file that is there isn't fetched again, and has the URL's name")
        for way, path in (("written", written), ("downloaded", downloaded)):
            with files.open_sesame(path) as file:
                found[way] = [x.rstrip("\n") for x in file if x.strip()]
    return spark.createDataFrame([(x, way) for way, lines in found.items() for x in lines], "line string, way string")


@query("SELECT r_regionkey || ' ' || r_name AS line, kind FROM region, (SELECT unnest(['zip', 'gz', 'xz', 'bz2', 'tar']) AS kind)")
def compressed_files_and_archives(spark, sf_dir):
    """Five rows through every kind of file that the driver opens."""
    import tarfile

    lines = "".join(f"{r['r_regionkey']} {r['r_name']}\n" for r in table(spark, sf_dir, "region").collect())  # regions
    found = {}
    with tempfile.TemporaryDirectory() as folder:  # of the driver alone
        for kind in ("gz", "xz", "bz2"):
            path = os.path.join(folder, "in", f"r.txt.{kind}")
            with files.open_sesame(path, mode="wt", encoding="utf-8", make_dirs=True) as file:
                file.write(lines)
            with files.open_sesame(path, encoding="utf-8") as file:
                found[kind] = file.read()
        with zipfile.ZipFile(os.path.join(folder, "all.zip"), "w") as z:
            z.writestr("all/regions.txt", lines)
        with tarfile.open(os.path.join(folder, "more.tar.gz"), "w:gz") as t:
            info = tarfile.TarInfo("more/regions.txt")
            info.size = len(lines)
            t.addfile(info, io.BytesIO(lines.encode()))
        for kind, name in (("zip", "all.zip"), ("tar", "more.tar.gz")):
            with open(os.path.join(files.unpack_archive(os.path.join(folder, name)), "regions.txt")) as file:
                found[kind] = file.read()
    if files.decompressed("x.gz", gzip.compress(lines.encode())) != lines.encode():
        raise RuntimeError("gzip content isn't what was compressed")
    return spark.createDataFrame([(x, kind) for kind, text in found.items() for x in text.splitlines()], "line string, kind string")


@query("SELECT o_orderpriority AS value FROM orders UNION ALL SELECT o_orderkey::VARCHAR FROM orders WHERE o_custkey >= 0")
def split_and_unzipped_records(spark, sf_dir):
    records = files.split_records(table(spark, sf_dir, "orders"), "o_orderpriority")
    content, key = files.unzip(records.where("meta.o_custkey >= 0").select("content", F.col("meta.o_orderkey").cast("string").alias("key")))
    return content.toDF("value").unionAll(key)


@query("SELECT DISTINCT 'segment=' || c_mktsegment AS folder FROM customer WHERE c_mktsegment <> 'BUILDING'")
def file_paths(spark, sf_dir):
    path = scratch(spark)
    table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_name").alias("text")).write.partitionBy("segment").text(path)
    found = files.get_filepaths(spark, path, match_regex="^part-", ignore_regex="crc$", extension=".txt", recursive=True)
    return found.select(F.regexp_extract("path", "(segment=[^/]+)/", 1).alias("folder")).where("folder <> 'segment=BUILDING'").distinct()


@query("SELECT page_id, regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '([^/]*)$', 1) AS name, lower(hex(encode(url))) AS sent, url AS received FROM pages")
def urls_and_content_types(spark, sf_dir):
    """The file a URL names, and the URL as bytes and as text again."""
    sent = files.coerce_content_type(F.col("url"), "wb")
    return table(spark, sf_dir, "pages").select("page_id", files.get_filename_from_url(F.col("url")).alias("name"), F.lower(F.hex(sent)).alias("sent"), files.coerce_content_type(sent, "wt").alias("received"))
