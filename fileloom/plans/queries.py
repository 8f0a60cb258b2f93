"""Registered queries of the conversion engine over the driver's tables, and their SQL.

The tables hold no file paths or image sizes, so inputs are derived from keys, in the same way on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fileloom.functions import formats, geometry, pages, paths, text
from fileloom.operators import planning, tasks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list[str], key: Column) -> Column:
    """The value at ``key`` modulo their number."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))


def sql_pick(values: list[str], key: str) -> str:
    listed = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"([{listed}])[({key} % {len(values)} + 1)::INT]"


NAMES = ["PNG", "jpeg", "Jpg", "markdown", "MD", "webp", "ico", "gif", "favicon", "AVIF", "both", "svg", "pdf", "docx", "html"]
FORMAT_CASE = "CASE WHEN lower({x}) = 'jpeg' THEN 'jpg' WHEN lower({x}) = 'markdown' THEN 'md' WHEN lower({x}) IN ('svg','favicon','png','jpg','webp','avif','pdf','md','docx') THEN lower({x}) END"


@query(f"SELECT p_partkey, name, {FORMAT_CASE.format(x='name')} AS format FROM (SELECT p_partkey, {sql_pick(NAMES, 'p_partkey')} AS name FROM part)")
def format_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", pick(NAMES, F.col("p_partkey")).alias("name"))
    return rows.withColumn("format", formats.parse_format(F.col("name")))


SHAPES = ["a/b/photo.PNG", "x/.hidden", "noext", "d.x/name", "deep/er/file.tar.GZ", "e/trailing.", ".dot/f.Md", "p/q.jpeg"]
EXT_SQL = r"lower(regexp_extract(path, '[^/]\.([^./]+)$', 1))"
SWAP_SQL = r"regexp_replace({p}, '([^/])\.[^./]*$', '\1')"


@query(rf"SELECT p_partkey, path, {EXT_SQL} AS extension, {SWAP_SQL.format(p='path')} || '.webp' AS swapped FROM (SELECT p_partkey, {sql_pick(SHAPES, 'p_partkey')} AS path FROM part)")
def extension_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    rows = table(spark, sf_dir, "part").select("p_partkey", pick(SHAPES, F.col("p_partkey")).alias("path"))
    return rows.select("p_partkey", "path", paths.extension(path).alias("extension"), paths.with_extension(path, F.lit("webp")).alias("swapped"))


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as files: /data/in/{source}/{doc_id}.md."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.concat(F.lit("/data/in/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.octet_length("text").cast("long").alias("length"))


FILES_SQL = "(SELECT doc_id, '/data/in/' || source || '/' || doc_id || '.md' AS path, strlen(text)::BIGINT AS length FROM documents)"


@query(f"SELECT doc_id, substr(path, 10) AS relative, '/out/' || regexp_replace(substr(path, 10), '\\.md$', '.docx') AS output_path, '/data/in/' || regexp_replace(substr(path, 10), '\\.md$', '.docx') AS in_place FROM {FILES_SQL}")
def relative_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, root, none = F.col("path"), F.lit("/data/in"), F.lit(None).cast("string")
    return document_files(spark, sf_dir).select("doc_id", paths.relative_to(path, root).alias("relative"), paths.batch_output(path, root, F.lit("/out"), F.lit("docx")).alias("output_path"), paths.batch_output(path, root, none, F.lit("docx")).alias("in_place"))


SOURCES, OUTPUTS = ["svg", "pdf", "md", "markdown", "png", "jpg", "webp"], ["out", "o/x.ico", "o/page.html", "o/y.PNG", "o/z.webp"]
DEFAULT_SQL = "CASE WHEN ext = 'svg' THEN 'favicon' WHEN ext = 'pdf' THEN 'png' WHEN ext IN ('md','markdown') THEN 'docx' ELSE 'webp' END"


@query(f"SELECT p_partkey, ext, output, {DEFAULT_SQL} AS default_target, CASE WHEN p_size % 7 = 0 THEN 'favicon' WHEN output = 'out' THEN {DEFAULT_SQL} WHEN output IN ('o/x.ico','o/page.html') THEN 'favicon' WHEN output = 'o/y.PNG' THEN 'png' ELSE 'webp' END AS target FROM (SELECT p_partkey, p_size, {sql_pick(SOURCES, 'p_partkey')} AS ext, {sql_pick(OUTPUTS, '(p_partkey // 7)')} AS output FROM part)")
def default_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size", pick(SOURCES, F.col("p_partkey")).alias("ext"), pick(OUTPUTS, F.floor(F.col("p_partkey") / 7)).alias("output"))
    return rows.select("p_partkey", "ext", "output", planning.default_target(F.col("ext")).alias("default_target"), planning.target_from_output(F.col("ext"), F.col("output"), F.lit(False), F.col("p_size") % 7 == 0).alias("target"))


WANTED = ["Both", "PNG", "jpeg", "webp", "gif", "BOTH", "Markdown"]


@query(f"SELECT doc_id, (t.i - 1)::INT AS target_idx, targets[t.i] AS target, regexp_replace(path, '\\.md$', '.' || targets[t.i]) AS output_path FROM (SELECT *, CASE lower(wanted) WHEN 'both' THEN ['webp','avif'] WHEN 'png' THEN ['png'] WHEN 'jpeg' THEN ['jpg'] WHEN 'webp' THEN ['webp'] WHEN 'markdown' THEN ['md'] ELSE [] END AS targets FROM (SELECT *, {sql_pick(WANTED, 'doc_id')} AS wanted FROM {FILES_SQL})), LATERAL (SELECT unnest(range(1, len(targets) + 1)) AS i) t")
def target_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = planning.expand_targets(document_files(spark, sf_dir), planning.target_list(pick(WANTED, F.col("doc_id"))))
    return rows.select("doc_id", "target_idx", "target", paths.with_extension(F.col("path"), F.col("target")).alias("output_path"))


PLACES = ["out", "o/x.ico", "o/page.png", "o/d.x/y", None]


@query(f"""SELECT p_partkey, output, target, is_dir, n, CASE WHEN output IS NULL THEN 'in/photo.' || ext WHEN is_dir THEN output || '/photo.' || ext WHEN n > 1 THEN CASE output WHEN 'o/x.ico' THEN 'o/x.' || ext WHEN 'o/page.png' THEN 'o/page.' || ext ELSE output || '.' || ext END ELSE output END AS single,
CASE WHEN output IS NULL THEN NULL WHEN is_dir OR output IN ('out', 'o/d.x/y') THEN output ELSE 'o' END AS package_dir, CASE WHEN output IS NULL THEN NULL WHEN is_dir OR output IN ('out', 'o/d.x/y') THEN 'favicon.ico' ELSE string_split(output, '/')[-1] END AS ico
FROM (SELECT *, CASE WHEN target = 'favicon' THEN 'ico' ELSE target END AS ext FROM (SELECT p_partkey, (['out','o/x.ico','o/page.png','o/d.x/y',NULL])[(p_partkey % 5 + 1)::INT] AS output, {sql_pick(['webp', 'favicon', 'jpg'], '(p_partkey // 5)')} AS target, p_size % 3 = 0 AS is_dir, (p_size % 2 + 1)::INT AS n FROM part))""")
def single_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where one file's output goes, and an icon package's folder and icon."""
    k = F.col("p_partkey")
    output = F.element_at(F.array(*[F.lit(v).cast("string") for v in PLACES]), (k % 5 + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", output.alias("output"), pick(["webp", "favicon", "jpg"], F.floor(k / 5)).alias("target"), (F.col("p_size") % 3 == 0).alias("is_dir"), (F.col("p_size") % 2 + 1).cast("int").alias("n"))
    single = paths.single_output(F.lit("in/photo.PNG"), F.col("target"), F.col("output"), F.col("is_dir"), F.col("n"))
    packed = F.when(F.col("output").isNotNull(), paths.package_paths(F.col("output"), F.col("is_dir")))
    return rows.select("*", single.alias("single"), packed["directory"].alias("package_dir"), packed["ico"].alias("ico"))


FILTERS, EXTENSIONS = ["png", "JPG", "jpeg", "webp", "avif", "svg", "pdf", "auto", "md"], ["png", "jpg", "jpeg", "webp", "avif", "svg", "pdf", "md", "txt", ""]


@query(f"SELECT p_partkey, filter_name, ext FROM (SELECT p_partkey, {sql_pick(FILTERS, 'p_partkey')} AS filter_name, {sql_pick(EXTENSIONS, '(p_partkey // 9)')} AS ext FROM part) WHERE CASE lower(filter_name) WHEN 'png' THEN ext = 'png' WHEN 'jpg' THEN ext IN ('jpg','jpeg') WHEN 'jpeg' THEN ext IN ('jpg','jpeg') WHEN 'webp' THEN ext = 'webp' WHEN 'avif' THEN ext = 'avif' WHEN 'svg' THEN ext = 'svg' WHEN 'pdf' THEN ext = 'pdf' ELSE ext IN ('png','jpg','jpeg') END")
def extension_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", pick(FILTERS, F.col("p_partkey")).alias("filter_name"), pick(EXTENSIONS, F.floor(F.col("p_partkey") / 9)).alias("ext"))
    return rows.filter(formats.extension_allowed(F.col("ext"), F.col("filter_name")))


HIDDEN = ["/r/a/b.png", "/r/.git/x.png", "/r/a/.cache", "/r/_keep/c.png", "/r/a.b/c.d", "/r/..x/y"]


@query(f"SELECT p_partkey, path, path LIKE '/r/.%' OR substr(path, 4) LIKE '%/.%' AS hidden FROM (SELECT p_partkey, {sql_pick(HIDDEN, 'p_partkey')} AS path FROM part)")
def hidden_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", pick(HIDDEN, F.col("p_partkey")).alias("path"))
    return rows.withColumn("hidden", paths.is_hidden(F.col("path"), F.lit("/r")))


GLOBS = ["a/b/*.png", "*.jpg", "/x/y?.md", "in/[ab].png", "plain/file.png", "half[open.png", "/abs/*/z", "dir/pre*"]


@query(f"SELECT p_partkey, pattern, contains(pattern, '*') OR contains(pattern, '?') OR (contains(pattern, '[') AND contains(pattern, ']')) AS is_glob, regexp_extract(pattern, '^[^*?\\[]*', 0) AS prefix, CASE WHEN base = '' THEN '.' ELSE base END AS base FROM (SELECT *, CASE WHEN regexp_extract(pattern, '^[^*?\\[]*', 0) LIKE '%/' THEN regexp_replace(regexp_extract(pattern, '^[^*?\\[]*', 0), '/$', '') ELSE regexp_extract(regexp_extract(pattern, '^[^*?\\[]*', 0), '^(.*)/[^/]*$', 1) END AS base FROM (SELECT p_partkey, {sql_pick(GLOBS, 'p_partkey')} AS pattern FROM part))")
def glob_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("pattern")
    rows = table(spark, sf_dir, "part").select("p_partkey", pick(GLOBS, F.col("p_partkey")).alias("pattern"))
    return rows.select("p_partkey", "pattern", paths.is_glob(p).alias("is_glob"), paths.glob_prefix(p).alias("prefix"), paths.glob_base(p).alias("base"))


FIT_SQL = """SELECT *, width <> ow OR height <> oh AS resized FROM (SELECT p_partkey, ow::BIGINT AS ow, oh::BIGINT AS oh, CASE WHEN stays THEN ow WHEN rw IS NOT NULL AND rh IS NOT NULL THEN greatest(round(ow * s), 1) WHEN rw IS NOT NULL THEN greatest(rw, 1) ELSE greatest(round(ow * (rh / oh)), 1) END::BIGINT AS width,
CASE WHEN stays THEN oh WHEN rw IS NOT NULL AND rh IS NOT NULL THEN greatest(round(oh * s), 1) WHEN rw IS NOT NULL THEN greatest(round(oh * (rw / ow)), 1) ELSE greatest(rh, 1) END::BIGINT AS height
FROM (SELECT *, least(rw / ow, rh / oh) AS s, CASE WHEN rw IS NOT NULL AND rh IS NOT NULL THEN nu AND least(rw / ow, rh / oh) >= 1 WHEN rw IS NOT NULL THEN nu AND rw >= ow WHEN rh IS NOT NULL THEN nu AND rh >= oh ELSE true END AS stays
FROM (SELECT p_partkey, (100 + p_size * 7)::DOUBLE AS ow, (50 + p_partkey % 900)::DOUBLE AS oh, CASE WHEN p_partkey % 4 IN (0, 1) THEN (p_partkey % 777 + 1)::DOUBLE END AS rw, CASE WHEN p_partkey % 4 IN (0, 2) THEN (p_partkey % 555 + 1)::DOUBLE END AS rh, p_partkey % 3 = 0 AS nu FROM part)))"""


@query(FIT_SQL)
def fit_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", (F.lit(100) + F.col("p_size") * 7).alias("ow"), (F.lit(50) + k % 900).alias("oh"),
        F.when((k % 4).isin(0, 1), k % 777 + 1).alias("rw"), F.when((k % 4).isin(0, 2), k % 555 + 1).alias("rh"), (k % 3 == 0).alias("nu"),
    )
    fitted = rows.select("p_partkey", F.col("ow").cast("long"), F.col("oh").cast("long"), geometry.fit_dimensions(F.col("ow"), F.col("oh"), F.col("rw"), F.col("rh"), F.col("nu")).alias("f"))
    return fitted.select("p_partkey", "ow", "oh", "f.width", "f.height", geometry.needs_resize(F.col("ow"), F.col("oh"), F.col("f")).alias("resized"))


@query("SELECT p_partkey, (greatest(p_size * 10 - 50, 1) / 72.0::DOUBLE)::DOUBLE AS scale, CASE WHEN p_partkey % 256 = 0 THEN 0 ELSE least((p_size * 5) * 255 // greatest(p_partkey % 256, 1), 255) END::INT AS channel FROM part")
def pixel_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part")
    return rows.select("p_partkey", geometry.dpi_scale(F.col("p_size") * 10 - 50).alias("scale"), geometry.unpremultiply(F.col("p_size") * 5, F.col("p_partkey") % 256).alias("channel"))


SPEC_SQL = "CASE p_partkey % 6 WHEN 0 THEN (p_size % 9 + 1) || ',' || (p_size % 5 + 1) || '-' || (p_size % 7 + 3) WHEN 1 THEN ' ' || p_size || ' , 2,2' WHEN 2 THEN '5-3' WHEN 3 THEN 'a' WHEN 4 THEN '1-' || (p_size * 2000) ELSE '1-2-3' END"
PARTS_SQL = f"""(SELECT p_partkey, spec, n, list_filter(list_transform(string_split(spec, ','), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS parts FROM (SELECT p_partkey, {SPEC_SQL} AS spec, (p_partkey % 12 + 1)::BIGINT AS n FROM part))"""
PAGES_SQL = f"""(SELECT p_partkey, spec, n, CASE WHEN len(list_filter(parts, lambda x: NOT CASE WHEN regexp_full_match(x, '[0-9]+') THEN x::BIGINT BETWEEN 1 AND 65535 WHEN regexp_full_match(x, '[0-9]+-[0-9]+') THEN string_split(x, '-')[1]::BIGINT BETWEEN 1 AND 65535 AND string_split(x, '-')[2]::BIGINT BETWEEN 1 AND 65535 AND string_split(x, '-')[1]::BIGINT <= string_split(x, '-')[2]::BIGINT ELSE false END)) = 0
THEN list_sort(list_distinct(flatten(list_transform(parts, lambda x: range(string_split(x, '-')[1]::BIGINT - 1, least(string_split(x, '-')[-1]::BIGINT, n)))))) END AS pages FROM {PARTS_SQL})"""


def page_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    text_of = lambda c: c.cast("string")
    spec = (
        F.when(k % 6 == 0, F.concat(text_of(s % 9 + 1), F.lit(","), text_of(s % 5 + 1), F.lit("-"), text_of(s % 7 + 3)))
        .when(k % 6 == 1, F.concat(F.lit(" "), text_of(s), F.lit(" , 2,2")))
        .when(k % 6 == 2, "5-3").when(k % 6 == 3, "a").when(k % 6 == 4, F.concat(F.lit("1-"), text_of(s * 2000))).otherwise("1-2-3")
    )
    rows = table(spark, sf_dir, "part").select("p_partkey", spec.alias("spec"), (k % 12 + 1).cast("long").alias("n"))
    return rows.withColumn("pages", pages.select_pages(F.col("spec"), F.col("n")))


@query(f"SELECT p_partkey, spec, n, CASE WHEN pages IS NULL THEN NULL ELSE array_to_string(pages, ',') END AS pages, CASE WHEN pages IS NULL THEN 'invalid page selection' WHEN len(pages) = 0 THEN 'No pages selected' END AS error FROM {PAGES_SQL}")
def page_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = page_specs(spark, sf_dir)
    return rows.select("p_partkey", "spec", "n", F.array_join("pages", ",").alias("pages"), pages.page_error(F.col("spec"), F.col("n")).alias("error"))


@query(f"SELECT p_partkey, (page + 1)::BIGINT AS page, 'o/doc' || p_partkey || '_page_' || (page + 1) || '.jpg' AS output_path FROM (SELECT p_partkey, unnest(pages) AS page FROM {PAGES_SQL})")
def page_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = page_specs(spark, sf_dir).select("p_partkey", F.explode("pages").alias("page"))
    path = F.concat(F.lit("o/doc"), F.col("p_partkey").cast("string"), F.lit(".jpg"))
    return rows.select("p_partkey", (F.col("page") + 1).alias("page"), paths.page_output(path, F.col("page") + 1).alias("output_path"))


def humanised(n: str) -> str:
    """SQL of a size with its unit."""
    units = [("B", 0), ("KB", 10), ("MB", 20), ("GB", 30), ("TB", 40)]
    number = "regexp_replace((round({n} / {d}.0::DOUBLE * 100) / 100)::VARCHAR, '\\.0$', '')"
    cases = " ".join(f"WHEN {n} < {1 << (b + 10)} THEN {number.format(n=n, d=1 << b)} || ' {u}'" for u, b in units)
    return f"CASE WHEN {n} = 0 THEN '0 B' {cases} END"


@query(f"SELECT doc_id, size, {humanised('size')} AS human FROM (SELECT doc_id, (n_chars * (1::BIGINT << (doc_id % 4 * 9)) * (doc_id % 5))::BIGINT AS size FROM documents)")
def size_humanize(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    size = F.col("n_chars") * F.pow(F.lit(2), k % 4 * 9).cast("long") * (k % 5)
    return table(spark, sf_dir, "documents").select("doc_id", size.alias("size")).withColumn("human", text.human_size(F.col("size")))


@query("SELECT page_id, CASE WHEN length(url) > 35 THEN '...' || right(url, 32) ELSE url END AS shown FROM pages")
def truncate_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.truncate_left(F.col("url"), 35).alias("shown"))


def order_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as tasks."""
    k, status = F.col("o_orderkey"), F.col("o_orderstatus")
    size = F.floor(F.col("o_totalprice")).cast("long")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("customer"), F.concat(F.lit("in/"), k.cast("string"), F.lit(".png")).alias("input_path"), F.concat(F.lit("out/"), k.cast("string"), F.lit(".webp")).alias("output_path"),
        F.when(status == "O", "success").when(status == "P", "skipped").otherwise("failed").alias("status"),
        size.alias("original_size"), F.floor(size * (k % 13) / 10).cast("long").alias("converted_size"), F.when(status == "F", "broken").alias("error_message"),
    )


TASKS_SQL = "(SELECT o_custkey AS customer, CASE o_orderstatus WHEN 'O' THEN 'success' WHEN 'P' THEN 'skipped' ELSE 'failed' END AS status, floor(o_totalprice)::BIGINT AS original_size, floor(floor(o_totalprice)::BIGINT * (o_orderkey % 13) / 10)::BIGINT AS converted_size FROM orders)"
SUMS_SQL = "coalesce(sum(original_size) FILTER (status <> 'failed'), 0)::BIGINT AS orig_size, coalesce(sum(converted_size) FILTER (status <> 'failed'), 0)::BIGINT AS new_size"


SAVINGS_SQL = f"CASE WHEN orig_size = 0 THEN '0 B (0% saved)' WHEN new_size > orig_size THEN '-' || {humanised('(new_size - orig_size)')} || ' (size increased)' ELSE {humanised('(orig_size - new_size)')} || ' (' || printf('%.1f', (orig_size - new_size) / orig_size::DOUBLE * 100) || '% saved)' END"


@query(f"SELECT count(*)::BIGINT AS total_tasks, count(*) FILTER (status = 'success')::BIGINT AS successful, count(*) FILTER (status = 'skipped')::BIGINT AS skipped, count(*) FILTER (status = 'failed')::BIGINT AS failed, bool_or(status = 'failed') AS any_failed FROM {TASKS_SQL}")
def task_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.counts(order_tasks(spark, sf_dir))


@query(f"SELECT customer, orig_size, new_size, orig_size - new_size AS saved_bytes, CASE WHEN orig_size > 0 THEN (orig_size - new_size) / orig_size::DOUBLE * 100 END AS saved_percent, {SAVINGS_SQL} AS savings FROM (SELECT customer, {SUMS_SQL} FROM {TASKS_SQL} GROUP BY customer)")
def savings_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = tasks.sizes(order_tasks(spark, sf_dir), "customer")
    return by.withColumn("savings", text.savings(F.col("orig_size"), F.col("new_size")))


@query("SELECT 'in/' || l_orderkey AS input_path, count(DISTINCT name)::BIGINT AS ok_outputs, count(*) FILTER (l_returnflag = 'R') = 0 AS safe FROM (SELECT *, CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_linenumber END AS name FROM lineitem) GROUP BY l_orderkey HAVING count(DISTINCT CASE WHEN l_linestatus = 'O' OR l_returnflag <> 'A' THEN name END) = 3 AND count(*) FILTER (NOT (l_linestatus = 'O' OR l_returnflag <> 'A')) = 0")
def delete_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as files of three targets, lines as tasks; a line that was returned has the input itself as its output."""
    lines = table(spark, sf_dir, "lineitem")
    source = F.concat(F.lit("in/"), F.col("l_orderkey").cast("string"))
    status = F.when(F.col("l_linestatus") == "O", "success").when(F.col("l_returnflag") != "A", "skipped").otherwise("failed")
    rows = lines.select(source.alias("input_path"), F.col("l_linenumber"), status.alias("status"), F.col("l_returnflag"))
    output = F.when(F.col("l_returnflag") == "R", F.col("input_path")).otherwise(F.concat("input_path", F.lit("."), F.col("l_linenumber").cast("string")))
    return tasks.delete_eligible(rows.withColumn("output_path", output), 3)


@query(f"SELECT a.doc_id, a.output_path, b.length AS existing_size, b.length IS NOT NULL AS skipped FROM (SELECT doc_id, '/out/' || doc_id || '.docx' AS output_path FROM {FILES_SQL}) a LEFT JOIN (SELECT '/out/' || doc_id || '.docx' AS path, n_chars AS length FROM documents WHERE doc_id % 2 = 0) b ON a.output_path = b.path")
def existing_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("/out/"), F.col("doc_id").cast("string"), F.lit(".docx"))
    plan = document_files(spark, sf_dir).select("doc_id", name.alias("output_path"))
    existing = table(spark, sf_dir, "documents").filter("doc_id % 2 = 0").select(name.alias("path"), F.col("n_chars").alias("length"))
    return planning.skip_existing(plan, existing, overwrite=False).select("doc_id", "output_path", "existing_size", "skipped")


@query("SELECT file_idx, target_idx, output_path, row_number() OVER (PARTITION BY output_path ORDER BY file_idx, target_idx) > 1 AS collides FROM (SELECT p_partkey AS file_idx, p_size AS target_idx, 'o/' || (p_partkey // 3) || CASE WHEN p_partkey % 2 = 0 THEN '.webp' ELSE '.avif' END AS output_path FROM part)")
def output_collision(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    path = F.concat(F.lit("o/"), F.floor(k / 3).cast("string"), F.when(k % 2 == 0, ".webp").otherwise(".avif"))
    plan = table(spark, sf_dir, "part").select(k.alias("file_idx"), F.col("p_size").alias("target_idx"), path.alias("output_path"))
    return planning.mark_collisions(plan).select("file_idx", "target_idx", "output_path", "collides")


@query("SELECT path, (row_number() OVER (ORDER BY string_split(path, '/')) - 1)::BIGINT AS file_idx FROM (SELECT 'a' || CASE WHEN p_partkey % 2 = 0 THEN '/' ELSE '-' END || p_partkey AS path FROM part)")
def component_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("a"), F.when(k % 2 == 0, "/").otherwise("-"), k.cast("string")).alias("path"))
    return planning.number_files(rows).select("path", "file_idx")


KINDS = list(text.EXIT_CODES)


@query(f"SELECT p_partkey, kind, CASE WHEN kind IN ('input_not_found','io_not_found') THEN 2 WHEN kind IN ('invalid_input','svg_parse') THEN 3 WHEN kind IN ('rendering','image','pdf_render','io_other') THEN 4 WHEN kind IN ('output_write','io_permission') THEN 5 WHEN kind = 'unsupported' THEN 6 END::INT AS code FROM (SELECT p_partkey, {sql_pick(KINDS, 'p_partkey')} AS kind FROM part)")
def exit_code_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", pick(KINDS, F.col("p_partkey")).alias("kind"))
    return rows.withColumn("code", text.exit_code(F.col("kind")))


PAIRS = ["svg", "favicon", "png", "jpg", "webp", "avif", "pdf", "md", "docx"]


@query(f"SELECT p_partkey, source, target, CASE WHEN source = 'md' AND target = 'docx' THEN 'markdown' WHEN source = 'pdf' AND target IN ('png','jpg','webp','avif') THEN 'pdf' WHEN source IN ('svg','png','jpg','webp','avif') AND target IN ('favicon','png','jpg','webp','avif') THEN 'image' END AS converter FROM (SELECT p_partkey, {sql_pick(PAIRS, 'p_partkey')} AS source, {sql_pick(PAIRS, '(p_partkey // 9)')} AS target FROM part)")
def converter_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", pick(PAIRS, F.col("p_partkey")).alias("source"), pick(PAIRS, F.floor(F.col("p_partkey") / 9)).alias("target"))
    return rows.withColumn("converter", formats.converter(F.col("source"), F.col("target")))


LISTED_SQL = """SELECT ord, "from", "to", description, n_parameters, label FROM (VALUES
(0, 'svg, png, jpg, jpeg, webp, avif', 'favicon', 'Convert an SVG or raster image to a Chrome favicon (.ico or full favicon package)', 1, '- [any] -> favicon: Convert an SVG or raster image to a Chrome favicon (.ico or full favicon package). Options: --package'),
(1, 'svg, png, jpg, jpeg, webp, avif', 'png', 'Convert images to PNG format', 4, '- [any] -> png: Convert images to PNG format'),
(2, 'svg, png, jpg, jpeg, webp, avif', 'jpg', 'Convert images to JPEG format', 5, '- [any] -> jpg: Convert images to JPEG format. Options: --quality'),
(3, 'svg, png, jpg, jpeg, webp, avif', 'webp', 'Convert images to WebP format', 6, '- [any] -> webp: Convert images to WebP format. Options: --quality, --lossless'),
(4, 'svg, png, jpg, jpeg, webp, avif', 'avif', 'Convert images to AVIF format', 6, '- [any] -> avif: Convert images to AVIF format. Options: --quality, --lossless'),
(5, 'svg, png, jpg, jpeg, webp, avif', 'both', 'Convert images to both WebP and AVIF formats', 6, '- [any] -> both: Convert images to both WebP and AVIF formats. Options: --quality, --lossless'),
(6, 'pdf', 'png, jpg, jpeg, webp, avif', 'Convert PDF pages to images', 6, '- pdf -> [png/jpg/webp/avif]: Convert PDF pages to images. Options: --pages, --dpi, --quality, --lossless'),
(7, 'md', 'docx', 'Convert Markdown documents to Microsoft Word (DOCX) files', 1, '- md -> docx: Convert Markdown documents to Microsoft Word (DOCX) files. Options: --overwrite')
) t(ord, "from", "to", description, n_parameters, label)"""


@query(LISTED_SQL)
def capability_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = formats.capability_label(F.col("from"), F.col("to"), F.col("description")).alias("label")
    return formats.capabilities(spark).select("ord", "from", "to", "description", F.size("parameters").alias("n_parameters"), label)


@query("SELECT p_partkey, CASE least(p_size, 6) WHEN 1 THEN 36 WHEN 2 THEN 32 WHEN 3 THEN 28 WHEN 4 THEN 24 WHEN 5 THEN 20 ELSE 18 END::INT AS heading_size, CASE WHEN p_size % 4 > 0 THEN p_size % 4 * 360 WHEN p_partkey % 2 = 0 THEN 720 ELSE 0 END::INT AS indent FROM part")
def paragraph_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part")
    return rows.select("p_partkey", text.heading_size(F.col("p_size")).alias("heading_size"), text.indent(F.col("p_partkey") % 2 == 0, F.col("p_size") % 4).cast("int").alias("indent"))


@query(f"SELECT p_partkey, 'Converted image from ' || {sql_pick(['png', 'svg', 'jpg', 'webp'], 'p_partkey')} || ' to ' || {sql_pick(['webp', 'avif', 'png'], '(p_partkey // 4)')} || ' (quality: ' || p_size || ', lossless: ' || CASE WHEN p_partkey % 2 = 0 THEN 'true' ELSE 'false' END || ')' AS description FROM part")
def descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    source, target = pick(["png", "svg", "jpg", "webp"], k), pick(["webp", "avif", "png"], F.floor(k / 4))
    return table(spark, sf_dir, "part").select("p_partkey", text.conversion_description(source, target, F.col("p_size"), k % 2 == 0).alias("description"))


@query("SELECT p_partkey, sum(s)::BIGINT AS converted_size, bool_and(d NOT LIKE '%failed%') AS none_failed FROM (SELECT p_partkey, p_size AS s, 'ok' AS d FROM part UNION ALL SELECT p_partkey, p_size * 2, CASE WHEN p_partkey % 5 = 0 THEN 'failed page' ELSE 'ok' END FROM part) GROUP BY p_partkey")
def output_files_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    def one(size: Column, note: Column) -> Column:
        return F.struct(size.cast("long").alias("size_bytes"), note.alias("description"))

    files = F.array(one(F.col("p_size"), F.lit("ok")), one(F.col("p_size") * 2, F.when(F.col("p_partkey") % 5 == 0, "failed page").otherwise("ok")))
    return table(spark, sf_dir, "part").select("p_partkey", tasks.converted_size(files).alias("converted_size"), tasks.none_failed(files).alias("none_failed"))


def conversion_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` planned to two targets; every third output exists already."""
    rows = planning.expand_targets(document_files(spark, sf_dir), F.array(F.lit("docx"), F.lit("png")))
    out = paths.batch_output(F.col("path"), F.lit("/data/in"), F.lit("/out"), F.col("target"))
    planned = rows.select("doc_id", F.col("path").alias("input_path"), "target", "length", out.alias("output_path"), formats.converter(F.lit("md"), F.col("target")).alias("converter"))
    existing = planned.filter("doc_id % 3 = 0 and target = 'docx'").select(F.col("output_path").alias("path"), F.floor(F.col("length") / 2).cast("long").alias("length"))
    return planning.skip_existing(planned, existing, overwrite=False)


@query(f"SELECT *, CASE WHEN orig_size > 0 THEN (orig_size - new_size) / orig_size::DOUBLE * 100 END AS saved_percent, {SAVINGS_SQL} AS savings FROM (" + """SELECT count(*)::BIGINT AS total_tasks, count(*) FILTER (status = 'success')::BIGINT AS successful, count(*) FILTER (status = 'skipped')::BIGINT AS skipped, count(*) FILTER (status = 'failed')::BIGINT AS failed, bool_or(status = 'failed') AS any_failed,
coalesce(sum(length) FILTER (status <> 'failed'), 0)::BIGINT AS orig_size, coalesce(sum(converted) FILTER (status <> 'failed'), 0)::BIGINT AS new_size, (coalesce(sum(length) FILTER (status <> 'failed'), 0) - coalesce(sum(converted) FILTER (status <> 'failed'), 0))::BIGINT AS saved_bytes, CASE WHEN bool_or(status = 'failed') THEN 1 ELSE 0 END AS exit_code
FROM (SELECT length, CASE WHEN t = 'png' THEN 'failed' WHEN doc_id % 3 = 0 THEN 'skipped' ELSE 'success' END AS status, CASE WHEN t = 'png' THEN 0 WHEN doc_id % 3 = 0 THEN length // 2 ELSE length // 4 END AS converted FROM """ + FILES_SQL + """, (VALUES ('docx'), ('png')) v(t)))""")
def conversion_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files to targets, outputs, what exists, what is unsupported, and the report's sums: one query end to end."""
    status = F.when(F.col("converter").isNull(), "failed").when(F.col("skipped"), "skipped").otherwise("success")
    size = F.when(F.col("converter").isNull(), 0).when(F.col("skipped"), F.col("existing_size")).otherwise(F.floor(F.col("length") / 4))
    done = conversion_plan(spark, sf_dir).select("input_path", "output_path", status.alias("status"), F.col("length").alias("original_size"), size.cast("long").alias("converted_size"))
    return tasks.summary(done)


@query()
def markdown_block_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fileloom.sources import manifest

    return manifest.markdown_blocks(table(spark, sf_dir, "documents"))


@query()
def docx_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document converted to DOCX; returns sizes."""
    from fileloom.operators import content

    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("/data/in/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("input_path"), F.lit("md").alias("from_format"), F.lit("docx").alias("to_format"), F.lit("markdown").alias("converter"), F.concat(F.lit("/out/"), F.col("doc_id").cast("string"), F.lit(".docx")).alias("output_path"), F.col("text").cast("binary").alias("content"))
    done = content.convert_tasks(docs)
    return done.select("input_path", "output_path", tasks.converted_size(F.col("files")).alias("converted_size"), "error")


def spread_parts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """``part`` dealt to all cores: it is a small file, and coding an image takes far longer than moving a row."""
    return table(spark, sf_dir, "part").select(*columns or "*").repartition(spark.sparkContext.defaultParallelism)


IMAGE_SUM = "list_sum(list_transform(range(480), lambda j: (j * (p_partkey % 251 + 1)) % 256))::BIGINT"
ICON_BYTES = "(6 + 3 * 16 + (40 + 4 * 16 * 16 + 16 * 4) + (40 + 4 * 32 * 32 + 32 * 4) + (40 + 4 * 48 * 48 + 48 * 8))"


@query(f"SELECT p_partkey, {ICON_BYTES}::INT AS ico_bytes, {IMAGE_SUM} AS png_sum, {IMAGE_SUM} AS webp_sum, (p_partkey % 256)::INT AS jpg_grey, (p_partkey % 40 + 1) * (p_size % 30 + 1)::BIGINT AS svg_pixels FROM part")
def codecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image per part, coded and decoded.

    ico_bytes: size of its icon, which the format gives; png_sum and webp_sum: its samples' sum after a round trip; jpg_grey: a
    grey of the part's after one through JPEG; svg_pixels: pixels that a rectangle of the part's covers.
    """
    from collections.abc import Iterator

    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        from fileloom.codecs import svg
        from fileloom.operators import raster

        for batch in batches:
            rows = []
            for key, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                pixels = ((np.arange(12 * 10 * 4) * (key % 251 + 1)) % 256).astype(np.uint8).reshape(12, 10, 4)
                png, webp = (raster.decode(raster.encode(pixels, kind)) for kind in ("png", "webp"))
                grey = raster.decode(raster.encode(np.full((9, 11, 3), key % 256, np.uint8), "jpg", 100))
                drawing = svg.parse_svg(f'<svg xmlns="http://www.w3.org/2000/svg" width="60" height="50"><rect x="3" y="4" width="{key % 40 + 1}" height="{size % 30 + 1}"/></svg>'.encode())
                covered = (drawing.render(60, 50)[:, :, 3] == 255).sum()
                rows.append((key, len(raster.encode_ico(raster.squares(png))), int(png.sum()), int(webp.sum()), int(grey.min()) if grey.min() == grey.max() else -1, int(covered)))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds], ["p_partkey", "ico_bytes", "png_sum", "webp_sum", "jpg_grey", "svg_pixels"])

    return spread_parts(spark, sf_dir, "p_partkey", "p_size").mapInArrow(run, "p_partkey long, ico_bytes int, png_sum long, webp_sum long, jpg_grey int, svg_pixels long")


@query("SELECT p_partkey, p::INT AS page, 'o/doc' || p_partkey || '_page_' || p || '.png' AS output_path, 'Page ' || p || ' of PDF' AS description, floor((20 + p_size + p) * 144 / 72.0 + 0.5)::INT AS width, floor((30 + p_partkey % 25) * 144 / 72.0 + 0.5)::INT AS height, (p_partkey % 200)::INT AS red FROM (SELECT *, unnest(range(1, p_partkey % 3 + 2)) AS p FROM part)")
def pdf_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A PDF per part with pages of its own sizes, each filled with a colour, drawn at 144 dots per inch and read back."""
    from collections.abc import Iterator

    import pyarrow as pa

    def made(key: int, size: int) -> bytes:
        n = key % 3 + 1
        out = b"%%PDF-1.4\n1 0 obj<</Type/Catalog/Pages 2 0 R>>endobj 2 0 obj<</Type/Pages/Kids[%s]>>endobj " % b" ".join(b"%d 0 R" % (10 + k) for k in range(n))
        fill = b"%g 0 0 rg 0 0 999 999 re f" % (key % 200 / 255)
        out += b"3 0 obj<</Length %d>>stream\n%s\nendstream endobj " % (len(fill), fill)
        return out + b" ".join(b"%d 0 obj<</Type/Page/MediaBox[0 0 %d %d]/Contents 3 0 R>>endobj" % (10 + k, 21 + size + k, 30 + key % 25) for k in range(n)) + b" trailer<</Root 1 0 R>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from fileloom.operators import content, raster

        for batch in batches:
            rows = []
            for key, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                files = content.convert_bytes(made(key, size), "pdf", "pdf", "png", f"o/doc{key}.png", content.Settings(dpi=144))
                for k, (path, data, description) in enumerate(files):
                    pixels = raster.decode(data)
                    rows.append((key, k + 1, path, description, pixels.shape[1], pixels.shape[0], int(pixels[0, 0, 0])))
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32())
            names = ["p_partkey", "page", "output_path", "description", "width", "height", "red"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds], names)

    return spread_parts(spark, sf_dir, "p_partkey", "p_size").mapInArrow(run, "p_partkey long, page int, output_path string, description string, width int, height int, red int")


NOTES = "concat(repeat('#', least(p_size % 8 + 1, 6)), ' ', p_name, '\n\n> said **', p_brand, '**\n\n- one\n  - ', p_type, '\n\n| A | B |\n| - | - |\n| ', p_size, ' | x |\n\n```\ncode ', p_partkey, '\n```\n')"


@query("""SELECT p_partkey, b.seq::INT AS seq, b.kind, b.level::INT AS level, b.depth::INT AS depth, b.quote, b.text FROM (SELECT p_partkey, unnest([
{'seq': 0, 'kind': 'heading', 'level': least(p_size % 8 + 1, 6), 'depth': 0, 'quote': false, 'text': p_name},
{'seq': 1, 'kind': 'paragraph', 'level': 0, 'depth': 0, 'quote': true, 'text': 'said ' || p_brand},
{'seq': 2, 'kind': 'paragraph', 'level': 0, 'depth': 1, 'quote': false, 'text': '•  one'},
{'seq': 3, 'kind': 'paragraph', 'level': 0, 'depth': 2, 'quote': false, 'text': '•  ' || p_type},
{'seq': 4, 'kind': 'table', 'level': 0, 'depth': 0, 'quote': false, 'text': 'A' || chr(9) || 'B' || chr(10) || p_size || chr(9) || 'x'},
{'seq': 5, 'kind': 'code', 'level': 0, 'depth': 0, 'quote': false, 'text': 'code ' || p_partkey}]) AS b FROM part)""")
def markdown_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A note of each part in Markdown, as blocks."""
    from fileloom.sources import manifest

    return manifest.markdown_blocks(table(spark, sf_dir, "part").select("p_partkey", F.expr(NOTES).alias("text")), "p_partkey")


@query("""SELECT p_partkey, (CASE least(p_size % 8 + 1, 6) WHEN 1 THEN 36 WHEN 2 THEN 32 WHEN 3 THEN 28 WHEN 4 THEN 24 WHEN 5 THEN 20 ELSE 18 END)::INT AS heading_size, p_brand AS bold, 1 AS tables, [720, 360, 720]::INT[] AS indents,
p_name || 'said ' || p_brand || '•  one' || '•  ' || p_type || 'AB' || p_size || 'x' || 'code ' || p_partkey AS text FROM part""")
def docx_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same notes as DOCX files, read back: size of the heading, bold text, tables, indents, all text."""
    from collections.abc import Iterator

    import pandas as pd

    from fileloom.operators import content

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import re
        import zipfile

        for frame in frames:
            rows = []
            for path, files in zip(frame["input_path"], frame["files"], strict=True):
                xml = zipfile.ZipFile(io.BytesIO(files[0]["bytes"])).read("word/document.xml").decode()
                runs = re.findall(r"<w:r>(.*?)</w:r>", xml, re.DOTALL)
                said = lambda x: "".join(re.findall(r"<w:t[^>]*>([^<]*)</w:t>", x))
                bold = "".join(said(r) for r in runs if "<w:b/>" in r and "<w:sz " not in r)
                rows.append((int(path), int(re.search(r'<w:sz w:val="(\d+)"', xml)[1]), bold, xml.count("<w:tbl>"), [int(x) for x in re.findall(r'<w:ind w:left="(\d+)"', xml)], "".join(map(said, runs))))
            yield pd.DataFrame(rows, columns=["p_partkey", "heading_size", "bold", "tables", "indents", "text"])

    notes = spread_parts(spark, sf_dir).select(F.col("p_partkey").cast("string").alias("input_path"), F.lit("md").alias("from_format"), F.lit("docx").alias("to_format"), F.lit("markdown").alias("converter"), F.lit("x.docx").alias("output_path"), F.expr(NOTES).cast("binary").alias("content"))
    return content.convert_tasks(notes).select("input_path", "files").mapInPandas(run, "p_partkey long, heading_size int, bold string, tables int, indents array<int>, text string")


@query("""SELECT to_json({'input_path': 'in/' || o_orderkey || '.png', 'output_path': 'out/' || o_orderkey || '.webp', 'status': CASE o_orderstatus WHEN 'O' THEN 'success' WHEN 'P' THEN 'skipped' ELSE 'failed' END, 'original_size': floor(o_totalprice)::BIGINT, 'converted_size': floor(floor(o_totalprice)::BIGINT * (o_orderkey % 13) / 10)::BIGINT, 'error_message': CASE WHEN o_orderstatus = 'F' THEN 'broken' END})::VARCHAR AS json FROM orders""")
def task_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks as the JSON report has them."""
    from fileloom.operators import sinks

    return sinks.results_json(order_tasks(spark, sf_dir).drop("customer"))
