"""Listing, batches, deletion, streams and the command line on real folders."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from fileloom import api, cli
from fileloom.operators import planning, raster, tasks
from fileloom.sources import manifest
from fileloom.sources.manifest import InputError
from fileloom.streaming import folder


def png(path, h=10, w=10):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(raster.encode_png(np.zeros((h, w, 4), np.uint8)))


@pytest.fixture
def tree(tmp_path):
    root = str(tmp_path / "in")
    for name in ("b.png", "a/x.PNG", "a-z.png", ".git/h.png", "_u.png"):
        png(f"{root}/{name}")
    open(f"{root}/empty.png", "w").close()
    open(f"{root}/note.txt", "w").close()
    return root


def test_manifest_keeps_what_sources_drop(spark, tree):
    got = {r.name for r in manifest.manifest(spark, tree, True).filter("kind = 'file'").collect()}
    assert got == {"b.png", "x.PNG", "a-z.png", "_u.png", "empty.png", "note.txt"}
    assert {r.name for r in manifest.batch_files(spark, tree, False).collect()} == {"b.png", "a-z.png", "_u.png", "empty.png"}
    assert manifest.batch_files(spark, tree, False, "pdf").count() == 0


def test_component_order(spark, tree):
    rows = planning.number_files(manifest.batch_files(spark, tree, True)).orderBy("file_idx").collect()
    names = [os.path.relpath(r.path, tree) for r in rows]
    assert names == sorted(names, key=lambda p: p.split("/")) and [r.file_idx for r in rows] == list(range(len(rows)))


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_numbers_are_exact_at_size(spark, adaptive):
    """Every row has its own number, in order, with narrow and wide rows."""
    n = 1_000_000
    k = F.xxhash64("id").bitwiseAND(0xFFFFF)
    path = F.concat(F.lit("r/"), F.hex(k % 97), F.when(k % 3 == 0, "/").otherwise("-"), F.hex(k), F.lit("/"), F.col("id").cast("string"), F.lit(".png"))
    narrow = spark.range(n).select(path.alias("path"), F.col("id").alias("length"), F.lit("png").alias("extension"))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        for rows in (narrow, narrow.withColumns({"part": F.repeat("path", 3), "row": F.lit(1), "before": F.lit(2)})):
            got = planning.number_files(rows)
            assert set(got.columns) == {*rows.columns, "file_idx"}
            found = got.selectExpr("file_idx", "split(path, '/') as parts", "path").agg(F.count("*").alias("n"), F.count_distinct("file_idx").alias("d"), F.count_distinct("path").alias("p"), F.min("file_idx").alias("lo"), F.max("file_idx").alias("hi")).first()
            assert tuple(found) == (n, n, n, 0, n - 1)
            sample = got.filter("file_idx % 1000 = 0").orderBy("file_idx").select("path").collect()
            names = [r.path.split("/") for r in sample]
            assert names == sorted(names)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_pages_of_a_pdf(spark, tmp_path):
    from tests.test_content import a_pdf

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.pdf").write_bytes(a_pdf([(100, 50)] * 5))
    (tmp_path / "in/b.pdf").write_bytes(b"%PDF nothing")
    single = str(tmp_path / "in/a.pdf")
    made = api.convert(spark, single, "png", str(tmp_path / "x.png"), options=api.Options(pages="4,1-2", dpi=72))
    assert [os.path.basename(f["path"]) for f in made] == ["x_page_1.png", "x_page_2.png", "x_page_4.png"] and made[0]["description"] == "Page 1 of PDF"
    again = api.convert(spark, single, "png", str(tmp_path / "x.png"), options=api.Options(pages="4-5", dpi=72))
    assert [f["description"] for f in again] == ["Skipped (already exists)", "Page 5 of PDF"]
    for spec, kind in (("9", "No pages selected"), ("x", "invalid page selection")):
        with pytest.raises(InputError, match=kind):
            api.convert(spark, single, "png", str(tmp_path / "y.png"), options=api.Options(pages=spec))
    rows = api.batch_convert(spark, str(tmp_path / "in"), "jpg", str(tmp_path / "o"), from_filter="pdf", options=api.Options(pages="2,3", dpi=36)).tasks.collect()
    assert [r.status for r in rows] == ["success", "failed"] and sorted(os.listdir(tmp_path / "o")) == ["a_page_2.jpg", "a_page_3.jpg"]
    assert raster.decode((tmp_path / "o/a_page_2.jpg").read_bytes()).shape == (25, 50, 3)
    none = api.batch_convert(spark, str(tmp_path / "in"), "jpg", str(tmp_path / "p"), from_filter="pdf", options=api.Options(pages="7")).tasks.first()
    assert none.status == "failed" and none.error_message == "Invalid input data: No pages selected"


def test_uris(spark, tree, tmp_path):
    """Paths that are URIs go through Arrow's file systems."""
    root, out = f"file://{tree}", f"file://{tmp_path}/uri"
    assert {r.name for r in manifest.batch_files(spark, root, True).collect()} == {"b.png", "x.PNG", "a-z.png", "_u.png", "empty.png"}
    rows = api.batch_convert(spark, root, "webp", out, recursive=True).tasks.collect()
    assert sorted(r.status for r in rows) == ["failed"] + ["success"] * 4 and os.path.exists(tmp_path / "uri/a/x.webp")
    assert api.batch_convert(spark, root, "webp", out, recursive=True).summary()["skipped"] == 4
    made = api.convert(spark, f"{root}/b.png", "jpg", options=api.Options(delete_original=True))
    assert made[0]["path"] == f"{root}/b.jpg" and os.path.exists(f"{tree}/b.jpg") and not os.path.exists(f"{tree}/b.png")
    with pytest.raises(InputError, match="not found"):
        api.convert(spark, f"{root}/none.png")


def test_large_folders_are_listed_in_shares(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(manifest, "ENTRIES", 10)
    for k in range(95):
        (tmp_path / f"f{k}.png").touch()
    reader = manifest.ManifestReader(str(tmp_path), False)
    shares = reader.partitions()
    names = [row[1] for share in shares for row in reader.read(share)]
    assert len(shares) == 10 and sorted(names) == sorted(f"f{k}.png" for k in range(95))


def test_vectors_and_photos(spark, tmp_path):
    (tmp_path / "logo.svg").write_text('<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 40 20"><rect width="40" height="20" fill="teal"/></svg>')
    made = api.convert(spark, str(tmp_path / "logo.svg"))  # the default target
    assert made[0]["path"].endswith("logo.ico") and made[0]["size_bytes"] == 15086
    package = api.convert(spark, str(tmp_path / "logo.svg"), "favicon", str(tmp_path / "icons"), options=api.Options(package=True))
    assert len(package) == 8 and raster.decode((tmp_path / "icons/apple-touch-icon.png").read_bytes()).shape == (180, 180, 4)
    photo = api.convert(spark, str(tmp_path / "logo.svg"), "jpg", str(tmp_path / "p.jpeg"), options=api.Options(width=80))
    assert raster.decode((tmp_path / "p.jpeg").read_bytes()).shape == (40, 80, 3) and photo[0]["path"].endswith("p.jpeg")
    assert api.convert(spark, str(tmp_path / "p.jpeg"))[0]["path"].endswith("p.webp")
    assert (raster.decode((tmp_path / "p.webp").read_bytes()) == raster.decode((tmp_path / "p.jpeg").read_bytes())).all()


def test_bad_inputs(spark, tree):
    for bad, kind in ((f"{tree}/none", "input_not_found"), (f"{tree}/b.png", "invalid_input")):
        with pytest.raises(InputError) as e:
            manifest.batch_files(spark, bad)
        assert e.value.kind == kind
    with pytest.raises(InputError, match="empty"):
        api.convert(spark, f"{tree}/empty.png", "png", f"{tree}/o.png")
    with pytest.raises(InputError) as e:
        api.convert(spark, f"{tree}/b.png", "pdf")
    assert e.value.kind == "unsupported"
    with pytest.raises(InputError):
        api.Options(quality=0)


def test_single_file(spark, tree, tmp_path):
    out = str(tmp_path / "o.png")
    png(f"{tree}/wide.png", 50, 100)
    made = api.convert(spark, f"{tree}/wide.png", "png", out, options=api.Options(width=50))
    assert raster.decode(open(out, "rb").read()).shape == (25, 50, 4) and made[0]["size_bytes"] == os.path.getsize(out)
    assert api.convert(spark, f"{tree}/wide.png", "png", out)[0]["description"] == "Skipped (already exists)"
    icons = api.convert(spark, f"{tree}/b.png", output=str(tmp_path / "icons"), options=api.Options(package=True))
    assert len(icons) == 8 and all(os.path.exists(f["path"]) for f in icons)
    (tmp_path / "t.md").write_text("# hi")
    assert api.convert(spark, str(tmp_path / "t.md"))[0]["path"].endswith("t.docx")


def test_in_place_is_never_deleted(spark, tree):
    path = f"{tree}/b.png"
    api.convert(spark, path, "png", options=api.Options(delete_original=True))
    assert os.path.exists(path)
    result = api.batch_convert(spark, tree, "png", options=api.Options(delete_original=True))
    assert result.deleted == 0 and os.path.exists(path)


def test_batch(spark, tree, tmp_path):
    out = str(tmp_path / "out")
    result = api.batch_convert(spark, tree, "png", out, recursive=True)
    rows = {os.path.relpath(r.input_path, tree): r for r in result.tasks.collect()}
    assert rows["a/x.PNG"].status == "success" and os.path.exists(f"{out}/a/x.png") and rows["empty.png"].status == "failed"
    assert result.exit_code == 1 and result.summary()["failed"] == 1 and result.summary()["total_tasks"] == 5
    again = api.batch_convert(spark, tree, "png", out, recursive=True).summary()
    assert (again["skipped"], again["failed"]) == (4, 1)
    both = api.batch_convert(spark, tree, "both", out).tasks.collect()
    assert len(both) == 8 and all(r.status == "success" if r.output_path.endswith(".webp") else "codec unavailable: avif" in r.error_message for r in both if "empty" not in r.input_path)
    seen = []
    plain = api.batch_convert(spark, tree, output_dir=str(tmp_path / "plain"), progress=lambda done, total: seen.append((done, total)))  # the default target
    assert plain.summary()["successful"] == 3 and seen and seen[-1][0] == seen[-1][1] > 0


def test_batch_deletes_only_what_is_done(spark, tree, tmp_path):
    result = api.batch_convert(spark, tree, "png", str(tmp_path / "o"), options=api.Options(delete_original=True))
    assert result.deleted == 3 and os.path.exists(f"{tree}/empty.png") and not os.path.exists(f"{tree}/b.png")


def test_collisions_fail_but_the_first(spark, tmp_path):
    for name in ("x.png", "x.jpg"):
        png(str(tmp_path / "c" / name))
    rows = api.batch_convert(spark, str(tmp_path / "c"), "favicon", str(tmp_path / "o")).tasks.collect()
    assert sorted((os.path.basename(r.input_path), r.status) for r in rows) == [("x.jpg", "success"), ("x.png", "failed")]


def test_explicit_files_and_empty_batch(spark, tree, tmp_path):
    rows = api.batch_convert(spark, tree, "png", str(tmp_path / "o"), files=[f"{tree}/b.png", f"{tree}/note.txt"]).tasks.collect()
    assert [r.status for r in rows] == ["success", "failed"]
    os.makedirs(tmp_path / "none")
    assert api.batch_convert(spark, str(tmp_path / "none"), "png").summary()["total_tasks"] == 0


def test_delete_eligibility(spark):
    rows = [("a", "a.w", "success"), ("a", "a.v", "skipped"), ("b", "b.w", "success"), ("b", "b.v", "failed"), ("c", "c", "success"), ("c", "c.v", "success"), ("d", "d.w", "success")]
    df = spark.createDataFrame([(*r, 1, 1, None) for r in rows], tasks.TASK.replace("status string, ", "status string, "))
    assert {(r.input_path, r.safe) for r in tasks.delete_eligible(df, 2).collect()} == {("a", True), ("c", False)}


def test_stream_converts_what_arrives(spark, tmp_path):
    root, out, state = (str(tmp_path / x) for x in ("s", "o", "state"))
    png(f"{root}/a.png")
    for name in ("a", "b"):
        png(f"{root}/{name}.png")
        folder.convert_arriving(folder.arriving(spark, root), "favicon", root, out, state).awaitTermination()
    assert os.path.exists(f"{out}/a.ico") and os.path.exists(f"{out}/b.ico")
    assert spark.read.parquet(f"{state}/tasks").filter("status = 'success'").select("output_path").distinct().count() == 2


def test_command_line(spark, tree, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda workers: spark)
    assert cli.main(["list-formats"]) == 0 and "- md -> docx" in capsys.readouterr().out
    assert cli.main(["--json", "list-formats"]) == 0 and len(json.loads(capsys.readouterr().out)) == 8
    assert cli.main(["--json", "convert", "-i", f"{tree}/nope.png"]) == 2 and json.loads(capsys.readouterr().err)["exit_code"] == 2
    assert cli.main(["convert", "-i", f"{tree}/b.png", "--to", "pdf"]) == 6
    assert cli.main(["convert", "-i", f"{tree}/*.png", "-o", f"{tree}/one.png", "--to", "png"]) == 3
    assert cli.main(["--json", "convert", "-i", f"{tree}/[ab]*.png", "-o", str(tmp_path / "g"), "--to", "png"]) == 0
    capsys.readouterr()
    assert cli.main(["convert", "-i", tree, "-o", str(tmp_path / "h"), "--to", "png"]) == 1 and "Failed:" in capsys.readouterr().out


def test_command_line_of_pages(spark, tmp_path, capsys, monkeypatch):
    from tests.test_content import a_pdf

    monkeypatch.setattr(cli, "session", lambda workers: spark)
    (tmp_path / "d.pdf").write_bytes(a_pdf([(72, 36)] * 3))
    assert cli.main(["--json", "convert", "-i", str(tmp_path / "d.pdf"), "-o", str(tmp_path / "x.jpg"), "--pages", "2-3", "--dpi", "100"]) == 0
    made = json.loads(capsys.readouterr().out)["output_files"]
    assert [os.path.basename(f["path"]) for f in made] == ["x_page_2.jpg", "x_page_3.jpg"] and raster.decode((tmp_path / "x_page_2.jpg").read_bytes()).shape == (50, 100, 3)
    assert cli.main(["convert", "-i", str(tmp_path / "d.pdf"), "-o", str(tmp_path / "y.png"), "--pages", "3-1"]) == 3
    assert cli.main(["convert", "-i", str(tmp_path), "--from", "pdf", "--to", "png", "-o", str(tmp_path / "o")]) == 0
    shown = capsys.readouterr()
    assert "tasks" in shown.err and "Successful:" in shown.out and len(os.listdir(tmp_path / "o")) == 3


def test_master_of_the_cluster_is_kept(monkeypatch):
    from pyspark import SparkContext

    monkeypatch.setattr(SparkContext, "_active_spark_context", None)
    for name in ("MASTER", "SPARK_REMOTE", "PYSPARK_GATEWAY_PORT", "PYSPARK_SUBMIT_ARGS"):
        monkeypatch.delenv(name, raising=False)
    assert not cli._configured_master()
    monkeypatch.setenv("PYSPARK_GATEWAY_PORT", "1")  # set by spark-submit
    assert cli._configured_master()
    monkeypatch.delenv("PYSPARK_GATEWAY_PORT")
    monkeypatch.setenv("PYSPARK_SUBMIT_ARGS", "--master yarn pyspark-shell")
    assert cli._configured_master()


def test_images_source(spark, tree):
    assert manifest.images(spark, tree).select(F.max("width")).first()[0] == 10
