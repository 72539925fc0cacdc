"""Queries that read formats: files are made of whole tables, detected, parsed and compared with the rows they came from."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text
from quire.sources import books, catalogue_db, detect, images, ocr

from .catalogue import query
from .function_queries import pick, pick_sql
from .library import table
from .made_files import book_file, catalogue_file, word_file

KINDS = ["epub", "fb2", "fbz", "htmlz", "pdb", "mobi", "tiff", "zip", "azw3"]
SOLID = r"[ \t\n\r]+"


def _made(spark, d):
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("t")))).alias("x"))
    key = F.col("conv_id").cast("string")
    kind = pick(F.col("conv_id"), KINDS)
    content = book_file(kind, F.concat(F.lit("Talk "), key), F.concat(F.lit("Author "), key), F.transform("x", lambda r: r["t"]))
    return turns.select(F.concat(F.lit("/b/"), key, F.lit(".bin")).alias("path"), content.alias("content"))


@query(
    f"""SELECT conv_id, {pick_sql("conv_id", KINDS)} AS format, CASE WHEN conv_id % 9 <> 7 THEN 'Talk ' || conv_id END AS title, CASE WHEN conv_id % 9 IN (4, 7) THEN NULL ELSE 'Author ' || conv_id END AS author, conv_id % 9 = 7 AS refused,
    CAST(CASE conv_id % 9 WHEN 8 THEN count(*) WHEN 0 THEN count(*) WHEN 1 THEN count(*) WHEN 2 THEN count(*) WHEN 6 THEN 0 WHEN 7 THEN 0 ELSE 1 END AS INTEGER) AS n_sections,
    sha256(CASE WHEN conv_id % 9 NOT IN (6, 7) THEN coalesce(regexp_replace(string_agg(text, '' ORDER BY turn), '[ \\t\\n\\r]+', '', 'g'), '') ELSE '' END) AS sha256 FROM conversations GROUP BY conv_id"""
)
def made_books(spark, d):
    """Conversations as EPUB, FB2 plain and zipped, zipped HTML, three Palm formats, TIFF tags and a broken archive, read back."""
    read = books.read_books(_made(spark, d))
    whole = F.array_join(F.transform(F.coalesce("sections", F.array()), lambda s: s["content"]), "")
    read = read.withColumn("conv_id", F.regexp_extract("book_id", r"(\d+)", 1).cast("long")).withColumn("plain", F.regexp_replace(text.plain_text(whole), SOLID, ""))
    return read.select("conv_id", "format", F.nullif("title", F.lit("")).alias("title"), F.try_element_at("authors", F.lit(1)).alias("author"), F.col("error").isNotNull().alias("refused"), F.coalesce(F.size("sections"), F.lit(0)).alias("n_sections"), F.sha2("plain", 256).alias("sha256"))


OCR = ["alto", "page", "hocr"]


@query(
    """WITH w AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS k FROM lineitem),
    v AS (SELECT l_orderkey, k, 'p' || l_partkey AS text, CAST(k * 50 AS DOUBLE) AS x, CAST(l_linenumber AS DOUBLE) AS y, CAST(30 + l_suppkey % 9 AS DOUBLE) AS w FROM w)
    SELECT l_orderkey, CAST(k AS INTEGER) AS k, text, x, y, w, CAST(10.0 AS DOUBLE) AS h, CAST(0.5 AS DOUBLE) AS confidence, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY l_orderkey ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS text_start FROM v"""
)
def ocr_words(spark, d):
    """Lines of orders as ALTO, PAGE and hOCR documents, read back as words with their places in the page's text."""
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    orders = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(row)).alias("r"))
    word = lambda r, k: F.struct(F.concat(F.lit("w"), k).alias("id"), F.concat(F.lit("p"), r["l_partkey"]).alias("text"), (k * 50).alias("x"), r["l_linenumber"].cast("int").alias("y"), (30 + r["l_suppkey"] % 9).cast("int").alias("w"), F.lit(10).alias("h"))
    files = orders.select(F.col("l_orderkey").cast("string").alias("path"), word_file(pick(F.col("l_orderkey"), OCR), F.transform("r", word)).alias("content"))
    found = ocr.with_offsets(ocr.read_zones(files))
    key, place = F.col("book_id").cast("long").alias("l_orderkey"), F.regexp_extract("id", r"(\d+)", 1).cast("int").alias("k")
    return found.select(key, place, "text", "x", "y", "w", "h", F.round("confidence", 6).alias("confidence"), "text_start")


@query(
    """SELECT n_nationkey AS library, c_custkey AS book_id, c_name AS title, ['By ' || c_name] AS authors, [c_mktsegment] AS tags, ['EPUB', 'PDF'] AS formats, CASE WHEN c_custkey % 2 = 1 THEN 'own' ELSE '978' || c_custkey END AS isbn
    FROM customer JOIN nation ON c_nationkey = n_nationkey"""
)
def catalogue_files(spark, d):
    """Customers of each nation as the books of a SQLite catalogue, read back with what the link tables give them."""
    c = table(spark, d, "customer")
    book = F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.concat(F.lit("By "), "c_name").alias("author"), F.col("c_mktsegment").alias("tag"), F.concat(F.lit("978"), F.col("c_custkey").cast("string")).alias("isbn"))
    files = c.groupBy("c_nationkey").agg(F.collect_list(book).alias("b")).select(F.col("c_nationkey").cast("string").alias("path"), catalogue_file(F.col("b")).alias("content"))
    read = catalogue_db.read_catalogue(files)
    return read.select(F.col("library").cast("long").alias("library"), "book_id", "title", "authors", "tags", "formats", F.try_element_at("identifiers", F.lit("isbn")).alias("isbn"))


def _hex4(number, width: int, little: bool = False):
    digits = F.lpad(F.hex(number), width * 2, "0")
    return F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in (reversed(range(width)) if little else range(width))])


IMAGES = ["png", "gif", "bmp", "jpeg", "webp"]


@query(f"SELECT p_partkey, CASE WHEN p_partkey % 6 < 5 THEN {pick_sql('p_partkey % 6', IMAGES)} END AS kind, CASE WHEN p_partkey % 6 < 5 THEN CAST(p_partkey % 9000 + 1 AS BIGINT) END AS width, CASE WHEN p_partkey % 6 < 5 THEN CAST(p_size AS BIGINT) END AS height FROM part")
def image_heads(spark, d):
    """Type and size of images from heads that were made with the sizes of parts."""
    w, h = F.col("p_partkey") % 9000 + 1, F.col("p_size").cast("long")
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), _hex4(w, 4), _hex4(h, 4), F.lit("0802000000"))
    gif = F.concat(F.lit("474946383961"), _hex4(w, 2, True), _hex4(h, 2, True), F.lit("000000"))
    bmp = F.concat(F.lit("424D"), F.lit("00" * 16), _hex4(w, 4, True), _hex4(h, 4, True), F.lit("0100180000000000"))
    jpeg = F.concat(F.lit("FFD8FFE000104A46494600010100000100010000" + "FFC0001108"), _hex4(h, 2), _hex4(w, 2), F.lit("03012200021101031101"))
    webp = F.concat(F.lit("52494646000000005745425056503858" + "0A00000000000000"), _hex4(w - 1, 3, True), _hex4(h - 1, 3, True))
    content = F.unhex(F.get(F.array(png, gif, bmp, jpeg, webp, F.lit("00112233")), (F.col("p_partkey") % 6).cast("int")))
    made = table(spark, d, "part").select("p_partkey", content.alias("c"))
    size = images.image_size(F.col("c"))
    return made.select("p_partkey", images.image_type(F.col("c")).alias("kind"), size["width"].alias("width"), size["height"].alias("height"))


HEADS = {"pdf": "255044462D312E37", "chm": "49545346", "djvu": "41542654464F524D", "tiff": "49492A00", "rtf": "7B5C72746631", "zip": "504B0304", "7z": "377ABCAF271C", "rar": "526172211A0700", "sqlite": "53514C69746520666F726D6174203300", "lrf": "4C0052004600", "unsupported": "EA44524D494F4E", "unknown": "0001020304"}


@query(f"SELECT c_custkey, {pick_sql('c_custkey', [*HEADS, 'txt', 'txt', 'html', 'fb2'])} AS format, c_custkey % 3 = 0 AS is_kf8 FROM customer")
def signatures(spark, d):
    """The ladder of signatures over made heads, the text heuristic, and the version of Palm books."""
    key, name = F.col("c_custkey"), F.encode("c_name", "UTF-8")
    heads = [F.concat(F.unhex(F.lit(h)), F.unhex(F.lit("00")) if k != "pdf" else F.unhex(F.lit("0A"))) for k, h in HEADS.items()]
    texts = [name, F.concat(F.unhex(F.lit("EFBBBF")), name), F.concat(F.encode(F.lit("<!DOCTYPE html><p>"), "UTF-8"), name), F.concat(F.encode(F.lit('<?xml version="1.0"?><FictionBook>'), "UTF-8"), name)]
    content = F.get(F.array(*heads, *texts), F.pmod(key, F.lit(len(heads) + len(texts))).cast("int"))
    palm = F.concat(F.unhex(F.lit("00" * 60)), F.encode(F.lit("BOOKMOBI"), "UTF-8"), F.unhex(F.lit("00" * 8 + "0001" + "00000058" + "00000000" + "0000")), F.unhex(F.lit("00" * 0x68)), F.unhex(F.when(key % 3 == 0, "00000008").otherwise("00000006")))
    return table(spark, d, "customer").select("c_custkey", detect.detected_format(content).alias("format"), (detect.refine_mobi(palm) == "azw3").alias("is_kf8"))


@query(f"SELECT conv_id, {pick_sql('conv_id', KINDS)} AS format, CASE WHEN conv_id % 9 <> 7 THEN 'Talk ' || conv_id END AS title, CASE WHEN conv_id % 9 NOT IN (4, 7) THEN 'Author ' || conv_id END AS author FROM conversations GROUP BY conv_id")
def made_metadata(spark, d):
    """The same files, of which only the metadata is read."""
    read = books.read_metadata(_made(spark, d))
    return read.select(F.regexp_extract("book_id", r"(\d+)", 1).cast("long").alias("conv_id"), "format", F.nullif("title", F.lit("")).alias("title"), F.try_element_at("authors", F.lit(1)).alias("author"))


@query(
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Beside ' || p_partkey WHEN 1 THEN 'Of the folder' WHEN 2 THEN p_name ELSE 'A - B ' || p_partkey END AS title,
    CASE p_partkey % 4 WHEN 0 THEN ['Own'] WHEN 1 THEN ['Folder'] WHEN 2 THEN ['Name'] ELSE ['Author ' || p_partkey] END AS authors FROM part"""
)
def sidecars_and_names(spark, d):
    """Metadata beside a book, of its folder, its own, and of its file name."""
    key, number = F.col("p_partkey"), F.col("p_partkey").cast("string")
    fourth = key % 4
    folder = F.when(fourth == 1, F.lit("/lib/common/")).otherwise(F.lit("/lib/own/"))
    path = F.concat(folder, F.when(fourth == 3, F.concat(F.lit("A - B "), number, F.lit(" - Author "), number)).when(fourth == 2, F.concat(F.lit("T "), number, F.lit(" - Name"))).otherwise(number), F.lit(".epub"))
    made = table(spark, d, "part").select("p_partkey", path.alias("book_id"), F.when(fourth == 3, "").otherwise(F.col("p_name")).alias("title"), F.array().cast("array<string>").alias("authors"))
    beside = made.where(fourth == 0).select(F.regexp_replace("book_id", "epub$", "opf").alias("path"), F.concat(F.lit("Beside "), number).alias("title"), F.array(F.lit("Own")).alias("authors"))
    common = spark.createDataFrame([("/lib/common/metadata.opf", "Of the folder", ["Folder"])], "path string, title string, authors array<string>")
    return books.with_sidecars(made, beside.unionByName(common)).select("p_partkey", "title", "authors")
