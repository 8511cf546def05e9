"""The command line end to end on a few shapes."""

import json

import pytest

from tessera import cli
from tessera.plans import render


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("cli")
    (base / "in.txt").write_text("37.78,-122.40 :3\n37.78,-122.40 :3\n37.79,-122.41 :9\n37.77,-122.42 37.80,-122.38 :5 // a line\nbad\n99,0\n")
    out = f"file://{base}/a"
    cli.main(["encode", "-z", "16", "-m", "8", "-o", out, f"{base}/in.txt"])
    return out, base


def test_enumerate(spark, indexed, capsys):
    out, _ = indexed
    cli.main(["enumerate", "-z", "3", "-v", out])
    first = capsys.readouterr().out.splitlines()[0].split()
    assert first[1:5] == ["0", "0", "0", "4"]
    cli.main(["enumerate", "-z", "2", "-s", "-v", "-d", out])
    rows = [x.split() for x in capsys.readouterr().out.splitlines()]
    assert sum(r[4] == "0" for r in rows) == 6 and all(len(r) == 7 for r in rows)
    assert [r[4:] for r in rows if r[1:4] == ["1", "1", "1"]] == [["0", "0.000000,0.000000", "0.000000"]]
    cli.main(["enumerate", "-z", "2", "-s", out])
    assert sorted(len(x.split()) for x in capsys.readouterr().out.splitlines()) == [4] * 9
    cli.main(["enumerate", "-z", "2", "-d", "-b", "30,-130,40,-100", out])
    assert [len(x.split()) for x in capsys.readouterr().out.splitlines()] == [5, 5, 5]
    cli.main(["enumerate", "-a", out])
    assert capsys.readouterr().out.count("//") == 4


def test_merge(spark, indexed, capsys):
    out, base = indexed
    cli.main(["merge", "-u", "-o", f"file://{base}/m", out, out])
    cli.main(["enumerate", "-a", f"file://{base}/m"])
    assert capsys.readouterr().out.count("//") == 3


def test_render(spark, indexed, capsys):
    out, base = indexed
    cli.main(["render", "-d", out, "11", "327", "791"])
    text = capsys.readouterr().out
    assert text.count("//") >= 1 and "8:" in text
    cli.main(["render", "-D", out, "0", "0", "0"])
    assert len(json.loads(capsys.readouterr().out)["features"]) == 4
    cli.main(["render", "-v", out])
    assert "line-opacity" in capsys.readouterr().out
    for extra in (["-C", "256", "-x", "b"], ["-x", "r", "-a"], ["-x", "c200f"], ["-M", "40", "-p", "g4"], ["-g", "-L", "3"], ["-r"]):
        cli.main(["render", *extra, "-o", f"{base}/tree", out, "11", "327", "791"])
        assert next((base / "tree/11/327").glob("791.png")).read_bytes().startswith(b"\x89PNG")
    cli.main(["render", "--format", "pbf", "-o", f"{base}/vec", out, "11", "327", "791"])
    assert (base / "vec/11/327/791.pbf").exists()


def test_standard_input(spark, indexed, capsys, monkeypatch):
    import io

    out, base = indexed
    lines = type("In", (io.StringIO,), {"buffer": io.BytesIO(b"37.78,-122.40 :3\n1,2\n")})()
    monkeypatch.setattr("sys.stdin", lines)
    cli.main(["encode", "-m", "8", "-o", f"file://{base}/piped"])
    assert not (base / "piped.input").exists()
    cli.main(["enumerate", "-z", "3", "-Z", "2", out])
    listed = capsys.readouterr().out
    monkeypatch.setattr("sys.stdin", io.StringIO(listed))
    cli.main(["render", "-o", f"{base}/all", out])
    assert len(list((base / "all").rglob("*.png"))) == len(listed.splitlines()) == 2
    monkeypatch.chdir(base)
    cli.main(["render", "--canned", out, "11", "327", "791"])
    assert (base / "tiles/a/11/327/791.png").exists()
    cli.main(["render", "--format", "txt", out, "11", "327", "791"])
    assert all(x.startswith("37.7") for x in capsys.readouterr().out.splitlines())


def test_box_without_seams(spark, indexed):
    from tessera.functions.style import Style
    from tessera.operators.dataset import Dataset

    image = render.box_image(spark, (Dataset(spark, indexed[0]),), 12, (37.70, -122.50), (37.85, -122.35), Style())
    assert image.startswith(b"\x89PNG")
    with pytest.raises(ValueError):
        render.tiles_of_box(20, (30.0, -130.0), (40.0, -100.0))
