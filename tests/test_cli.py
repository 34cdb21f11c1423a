"""The command line over small files: batch and convert write what they say, config answers."""

import glob
import json

import pytest

from quirework import cli
from quirework.plans import protocols

PAGE = '<article class="ltx_document"><h1 class="ltx_title ltx_title_document">T</h1><section class="ltx_section"><h2>One</h2><p>text</p>\n<figure class="ltx_figure"><svg></svg></figure></section></article>'


class Closing:
    closed = 0

    def __call__(self, url):
        return (200, "text/html", PAGE.encode()) if "00001" in url else (404, "", b"")

    def close(self):
        Closing.closed += 1


def make_fetcher():
    return Closing()


def test_batch_writes_files(spark, tmp_path):
    (tmp_path / "a.html").write_text(PAGE)
    (tmp_path / "lines").write_text(f"# c\n2101.00001\n{tmp_path}/a.html\n")
    out = str(tmp_path / "out")
    args = ["batch", str(tmp_path / "lines"), "--output", out, "--fetcher", "test_cli:make_fetcher"]
    assert cli.main(args) == 0
    assert sorted(r.value.strip() for r in spark.read.text(out, wholetext=True).select("value").collect()) == ["## One\n\ntext\n\n![](images/figure-1.svg)"] * 2
    (tmp_path / "lines").write_text("2101.00009\n")
    assert cli.main(args[:2] + ["--fetcher", "test_cli:make_fetcher", "--fail-fast"]) == 1


def test_convert_writes_drawn_figures(spark, tmp_path):
    (tmp_path / "a.html").write_text(PAGE)
    out = str(tmp_path / "out")
    assert cli.main(["convert", str(tmp_path / "a.html"), "--output", out, "--json", "meta"]) == 0
    assert [r.value.strip() for r in spark.read.text(out + "-images").collect()] == ["<svg></svg>"]
    assert json.loads(spark.read.text(out + "-bundle/json").first().value)["title"] == "T"


def test_records_as_yaml(spark, tmp_path):
    (tmp_path / "r.xml").write_text("<feed><entry><id>http://arxiv.org/abs/2101.00001v1</id><title>A B</title><author><name>Ada</name></author></entry></feed>")
    assert cli.main(["paper-yml", str(tmp_path / "r.xml"), "--output", str(tmp_path / "out")]) == 0
    text = "".join(open(f).read() for f in glob.glob(str(tmp_path / "out" / "*" / "*.txt")))
    assert "A B" in text and "arxiv:2101.00001" in text


def test_config(tmp_path, capsys):
    path = str(tmp_path / "q.json")
    assert cli.main(["config", "init", path]) == 0 and cli.main(["config", "init", path]) == 1
    assert json.load(open(path))["http"]["retries"] == 3
    assert cli.main(["config", "get", "http.retries"]) == 0 and capsys.readouterr().out.strip().endswith("3")
    assert cli.main(["config", "get", "no.such"]) == 2 and cli.main(["config", "validate"]) == 0


def test_protocols():
    assert isinstance(protocols.PageBuilder(), protocols.Builder) and all(isinstance(e, protocols.Emitter) for e in (protocols.MarkdownEmitter(), protocols.JsonEmitter("meta"), protocols.NodeEmitter()))


def test_shared_folder_is_refused_off_one_machine(monkeypatch):
    from types import SimpleNamespace

    from quirework.functions.session import shared_folder

    def session(master, folder=None):
        return SimpleNamespace(sparkContext=SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda k: folder)), conf=SimpleNamespace(get=lambda k, d: d, set=lambda k, v: None))

    for master in ("yarn", "spark://x:7077", "local-cluster[2,1,512]"):
        with pytest.raises(RuntimeError):
            shared_folder(session(master))
        assert shared_folder(session(master, "file:///shared")) == "file:///shared"
