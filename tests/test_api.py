from vellumspark import api
from vellumspark.sources.fonts import Font
from vellumspark.streaming import sources


def test_command_line(spark, tmp_path, capsys):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.md").write_text("")
    (folder / "b.html").write_text("<title>t</title><hr>")
    css = tmp_path / "s.css"
    css.write_text("p { color: red }")
    out = f"file://{tmp_path}/out"
    assert api.main(["compile", f"file://{folder}", "--out", out, "--css", str(css)], spark) == 0
    assert api.main(["validate", out], spark) == 0
    assert api.main(["inspect", out], spark) == 0 and "chunks hr 1" in capsys.readouterr().out
    (folder / "c.txt").write_text("x")
    assert api.main(["compile", f"file://{folder}", "--out", out], spark) == 2
    (folder / "c.txt").unlink()
    (folder / "d.html").write_bytes(b"<p>\xff")
    assert api.main(["compile", f"file://{folder}", "--out", out], spark) == 1
    assert api.main([], spark) == api.main(["compile", "x"], spark) == api.main(["validate", "x", "--out", "y"], spark) == 2


def test_text_compiles_to_a_valid_package(spark, tmp_path, capsys):
    from .test_atlas import png
    from .test_fonts import font

    (tmp_path / "in").mkdir()
    (tmp_path / "fonts").mkdir()
    (tmp_path / "img").mkdir()
    (tmp_path / "in/a.md").write_text("AB CA\n\n![](x.png)\n\nBZ")
    (tmp_path / "fonts/f.ttf").write_bytes(font())
    (tmp_path / "img/x.png").write_bytes(png(4, 2, 3, b"\0" * 26))
    at = lambda x: f"file://{tmp_path}/{x}"
    css = tmp_path / "s.css"
    family = Font(font()).family()
    css.write_text(f"body, p, div {{ font-family: \"{family or 'Noto Sans'}\" }}")
    asked = ["compile", at("in"), "--out", at("out"), "--files", "--css", str(css), "--fonts", at("fonts")]
    assert api.main([*asked, "--images", at("img")], spark) == 0
    assert "U+005A" in capsys.readouterr().err and (tmp_path / "out/a.pkg").stat().st_size > 100
    assert api.main(["validate", at("out")], spark) == 0
    assert api.main(["inspect", at("out")], spark) == 0 and "images images 1" in capsys.readouterr().out
    assert api.main(asked, spark) == 1 and "image not found: x.png" in capsys.readouterr().err
    # text without a face for it isn't a valid package
    assert api.main(["compile", at("in"), "--out", at("none"), "--images", at("img")], spark) == 1
    assert "self-validation found" in capsys.readouterr().err


def test_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.html").write_text("<p>x<p>y")
    (folder / "b.html").write_text("<p>x<p>y")
    (folder / "c.md").write_text("- a")
    stream = sources.chunk_counts(sources.distinct_sources(sources.read_files(spark, f"file://{folder}")))
    q = stream.writeStream.format("memory").queryName("counts").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {}
    for r in spark.table("counts").collect():
        got[r["kind"]] = got.get(r["kind"], 0) + r["n"]
    assert got == {"document": 2, "paragraph": 3, "run": 3, "list": 1, "list_item": 1}
