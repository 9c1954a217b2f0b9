"""Folders of one file a document, and results kept by run."""

import json

import pytest

from leafloom.sources import folders, runs, tables


@pytest.fixture(scope="module")
def formats(spark):
    folders.register(spark)
    return spark


def docs(spark, rows):
    return spark.createDataFrame(rows, "stem string, format string, text string").repartition(3)


def test_transcripts_round_trip(formats, tmp_path):
    rows = [("a", "markdown", "one\n\ntwo"), ("b.x", "text", "ñ 漢 😀"), ("c", None, "  padded \n"), ("d", "markdown", ""), ("e", "text", None)]
    docs(formats, rows).write.format("transcripts").mode("append").save(str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.md", "b.x.txt", "c.md", "d.md", "e.txt"]
    assert (tmp_path / "out" / "a.md").read_text() == "# a\n\none\n\ntwo\n"
    back = formats.read.format("transcripts").option("files_per_task", "2").load(str(tmp_path / "out"))
    assert back.rdd.getNumPartitions() == 3
    assert sorted(map(tuple, back.collect())) == [("a", "markdown", "one\n\ntwo"), ("b.x", "text", "ñ 漢 😀"), ("c", "markdown", "padded"), ("d", "markdown", ""), ("e", "text", "")]
    assert formats.read.format("transcripts").load(str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("bad", [("z", "docx", "no such format"), ("../z", "text", "outside"), (".z", "text", "hidden"), ("a", "markdown", "there already")])
def test_a_failed_write_leaves_nothing(formats, tmp_path, bad):
    docs(formats, [("a", "markdown", "first")]).write.format("transcripts").mode("append").save(str(tmp_path))
    with pytest.raises(Exception):
        docs(formats, [(f"n{i}", "text", "x") for i in range(20)] + [bad]).write.format("transcripts").mode("append").save(str(tmp_path))
    assert [p.name for p in tmp_path.iterdir()] == ["a.md"] and (tmp_path / "a.md").read_text() == "# a\n\nfirst\n"


def test_two_documents_of_one_name_are_refused_and_overwrite_replaces(formats, tmp_path):
    with pytest.raises(Exception):
        docs(formats, [("a", "text", "x"), ("a", "text", "y")]).repartition(2).write.format("transcripts").mode("append").save(str(tmp_path / "o"))
    for text in ("x", "y"):
        docs(formats, [("a", "text", text)]).write.format("transcripts").option("overwrite", "true").mode("append").save(str(tmp_path / "o"))
    assert [p.name for p in (tmp_path / "o").iterdir()] == ["a.txt"] and (tmp_path / "o" / "a.txt").read_text() == "y\n"


def test_triage_folder(formats, tmp_path):
    held = [
        ("a.png", "a", "below the gate", "2026-01-01T00:00:00+00:00", "auto", [("e1", 0.05, "line one\nline two " + "x" * 600), ("e2", 0.05, "two"), ("e3", None, None)], "1"),
        ("b.pdf", "b", "too many pages", "", None, [], "1"),
    ]
    formats.createDataFrame(held, folders.HELD).write.format("triage").mode("append").save(str(tmp_path))
    (tmp_path / "old.md").write_text("# old\n")
    (tmp_path / "old.tif").write_bytes(b"II*\0")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.e1.txt", "a.e2.txt", "a.e3.txt", "a.json", "a.md", "b.json", "b.md", "old.md", "old.tif"]
    record = json.loads((tmp_path / "a.json").read_text())
    assert record["best"] == {"engine": "e1", "score": 0.05} and record["candidates"][1] == {"backend": "e2", "score": 0.05, "transcript": "a.e2.txt"}
    assert (tmp_path / "a.e1.txt").read_text() == held[0][5][0][2]
    page = (tmp_path / "a.md").read_text()
    assert "| e1 | 0.0500 |\n| e2 | 0.0500 |\n\n" in page and "### e1\n\nline one line two " in page and "x" * 482 in page and "x" * 483 not in page
    items = {r["stem"]: r for r in formats.read.format("triage").load(str(tmp_path)).collect()}
    assert set(items) == {"a", "b", "old"}
    assert items["a"]["best"]["engine"] == "e1" and len(items["a"]["candidates"]) == 3 and items["a"]["manifest"] == "a.md"
    assert (items["b"]["best"], items["b"]["candidates"], items["b"]["reason"]) == (None, [], "too many pages")
    assert (items["old"]["file"], items["old"]["record"], items["old"]["reason"]) == ("old.tif", None, "held before records were written; see old.md")
    assert formats.read.format("triage").load(str(tmp_path / "none")).count() == 0
    assert tables.triage_records(formats, str(tmp_path)).count() == 2 and tables.triage_records(formats, str(tmp_path / "none")).count() == 0


def test_runs_are_kept_once_and_compared(spark, tmp_path):
    folder, schema = str(tmp_path / "runs"), "backend string, chr double"
    assert runs.kept(spark, folder, schema).count() == 0
    first, second = runs.run_id("2026-01-01_000000", "abc", "a-b"), runs.run_id("2026-01-02_000000", "def")
    assert first == "2026-01-01_000000_abc_a_b" < second
    table = lambda rows: spark.createDataFrame(rows, schema)
    for _ in range(2):
        runs.keep(table([("a", 0.5), ("b", 0.25)]), folder, first)
    runs.keep(table([("a", 0.75), ("c", None)]), folder, second)
    everything = runs.kept(spark, folder, schema)
    assert everything.count() == 4
    assert {r["backend"]: (r["chr"], r["run_id"]) for r in runs.latest(everything, ["backend"]).collect()} == {"a": (0.75, second), "b": (0.25, first), "c": (None, second)}
    got = {r["backend"]: (r["chr_before"], r["chr_after"], r["chr_change"], r["state"]) for r in runs.compared(everything, first, second, ["backend"], ["chr"]).collect()}
    assert got == {"a": (0.5, 0.75, 0.25, "kept"), "b": (0.25, None, None, "gone"), "c": (None, None, None, "added")}
    with pytest.raises(ValueError):
        runs.keep(everything, folder, first)


def test_registry_says_what_can_run(spark):
    from leafloom.sources import engines

    registry = engines.Registry()
    base = registry.add(engines.per_file("plain", lambda c, s, mark="": c + mark, (".png",)))
    registry.add(engines.Engine("absent", base.transcribe, (".png",), requires=("no_such_module",), extra="ocr"))
    registry.add(engines.Engine("gone", base.transcribe, (".png",), requires=("no_such_module",), withdrawn="use another"))
    registry.wrapper("louder", "plain", engines.per_file("x", lambda c, s, mark="": c + mark, (), mark="!").transcribe)
    assert registry.available() == ["plain", "louder"] and registry.get("louder").suffixes == (".png",)
    with pytest.raises(engines.MissingEngine, match="needs no_such_module; install the extra 'ocr'"):
        registry.get("absent")
    with pytest.raises(engines.WithdrawnEngine, match="use another"):
        registry.get("gone")
    with pytest.raises(engines.UnknownEngine, match="plain, absent, gone, louder"):
        registry.get("other")
    with pytest.raises(ValueError):
        registry.add(base)
    rows = {r["engine"]: (r["engine_ord"], r["available"], r["error"]) for r in registry.capabilities(spark).collect()}
    assert rows["plain"] == (0, True, None) and rows["gone"] == (2, False, "use another")
    names = spark.createDataFrame([(n,) for n in ("zz", "louder", "aa", "plain")], "engine string")
    assert [r["engine"] for r in registry.ordered(names).collect()] == ["plain", "louder", "aa", "zz"]


def test_cache_fills_only_what_it_lacks(spark, tmp_path):
    from leafloom.sources import engines

    calls = tmp_path / "calls"
    calls.mkdir()

    def read(content, suffix, fails=("bad",)):
        (calls / content).write_text("x")
        if content in fails:
            raise RuntimeError("torn page")
        return content.upper()

    folder = str(tmp_path / "cache")
    files = spark.createDataFrame([("a", ".png", 1, "one"), ("b", ".png", 1, "bad"), ("c", ".pdf", 3, "long"), ("d", ".txt", 1, "no")], "file string, suffix string, pages int, content string")
    own = [engines.per_file("e", read, (".png", ".pdf")), engines.per_file("single", read, (".png", ".pdf"), single_page=True), engines.existing("kept", "content", (".png",))]
    assert engines.fill(files, own, folder) == 3 + 2 + 2
    rows = {(r["engine"], r["file"]): (r["text"], r["error"]) for r in engines.cached(spark, folder).collect()}
    assert rows["e", "a"] == ("ONE", None) and rows["e", "b"] == (None, "RuntimeError: torn page") and ("single", "c") not in rows and rows["kept", "b"] == ("bad", None)
    for p in calls.iterdir():
        p.unlink()
    assert engines.fill(files, own, folder) == 0 and not list(calls.iterdir())
    more = files.union(spark.createDataFrame([("n", ".png", 1, "new")], files.schema))
    assert engines.fill(more, own, folder) == 3 and {p.name for p in calls.iterdir()} == {"new"}
    mended = [engines.per_file("e", read, (".png", ".pdf"), fails=())]
    assert engines.fill(more, mended, folder, again=True) == 1
    rows = {(r["engine"], r["file"]): r["text"] for r in engines.cached(spark, folder).collect()}
    assert rows["e", "b"] == "BAD" and rows["e", "a"] == "ONE" and len(rows) == 10
    texts = {(r["file"], r["engine"]): r["text"] for r in engines.transcribed(files, own).collect()}
    assert texts["a", "e"] == "ONE" and texts["b", "e"] is None and texts["b", "kept"] == "bad"


def test_a_batch_is_written_once_with_its_totals(spark, tmp_path):
    from pyspark.sql import functions as F

    from leafloom.operators import batch, log

    files = spark.createDataFrame([(f, f"p/{f}.png", w, 10, 1) for f, w in (("a", 10), ("b", 40_000), ("c", 10), ("d", 10))], "file string, path string, width int, height int, pages int")
    scored = spark.createDataFrame([("a", 0, "e", "text here", 2, 0.5), ("c", 0, "e", "poor", 1, 0.01)], "file string, engine_ord int, engine string, text string, words long, score double")
    rows = batch.processed(files, scored, "md")
    totals = batch.write_run(rows, str(tmp_path), "r1")
    assert totals == {"files": 4, "processed": 1, "triaged": 2, "errors": 1}
    written = spark.read.json(str(tmp_path / "log"))
    finishes = written.where("event = 'file_finish'")
    assert log.run_totals(finishes).first().asDict() == {"run": "r1", **totals}
    assert {r["file"]: (r["outcome"], r["reason"]) for r in finishes.collect()} == {"a": ("processed", None), "b": ("refused", "side too long"), "c": ("triaged", None), "d": ("error", "no engine read the file")}
    end = written.where("event = 'run_finish'").first()
    assert (end["files"], end["errors"]) == (4, 1) and written.where("event = 'run_start'").count() == 1 and written.count() == 10
    manifest = spark.read.csv(str(tmp_path / "manifest"), header=True)
    assert manifest.columns == tables.MANIFEST and {r["file"]: r["location"] for r in manifest.collect()} == {"a": "processed", "b": "triage", "c": "triage", "d": "scans"}
    # The same run again replaces its file rows.
    batch.write_run(rows, str(tmp_path), "r1")
    assert spark.read.parquet(str(tmp_path / "files")).groupBy("run_id").agg(F.count("*").alias("n")).collect() == [("r1", 4)]
