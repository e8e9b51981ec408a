"""The command line over a small corpus folder."""

import csv

import pytest

from termloom import cli
from termloom.config import Settings
from termloom.plans.corpus import Corpus


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("corpus")

    def sheet(name, rows):
        with open(base / f"{name}.csv", "w", newline="") as f:
            out = csv.writer(f)
            out.writerow(["CONTENT", "TITLE", "URL", "CAT1", "CAT2"])
            out.writerows(rows)

    good, bad = ["fraud scandal leak", "scandal police fraud", "leak of fraud report"], ["flower garden spring", "spring rain garden", "garden of flower beds"]
    sheet("pos", [(good[i % 3] + f" case{i % 4}", f"title {i}", f"u{i}", "neg", "crime") for i in range(24)])
    sheet("unl", [(bad[i % 3] + f" note{i % 4}" if i % 6 else good[i % 3], f"story {i}", "" if i % 5 == 0 else f"v{i}", "other" if i % 2 else "neg", "x") for i in range(36)] + [("", "no body", "w", "gone", "")])
    for name in ("pos", "unl"):
        run(spark, base, "import_samples", "--xls_file", str(base / f"{name}.csv"), name=name)
        run(spark, base, "rebuild", name=name)
    return base


def run(spark, base, *argv, name="pos"):
    cli.main(["--corpus_dir", str(base / "c"), "--samples_name", name, "--result_dir", str(base / "out"), *argv], spark, Settings(()))


def lines(spark, base, name):
    return [r["value"] for r in spark.read.text(str(base / "out" / name)).collect()]


def test_import_and_rebuild(spark, folder):
    corpus = Corpus(spark, str(folder / "c"))
    assert corpus.samples("pos").count() == 24 and corpus.samples("unl").count() == 37
    assert {r["cat1"] for r in corpus.categories().filter("level = 1").collect()} == {"neg", "other", "gone"}
    assert corpus.terms("pos").filter("term = 'fraud'").count() == 24
    assert corpus.dimensions("unl").count() == 37


def test_reports_and_exports(spark, folder, capsys):
    run(spark, folder, "show")
    run(spark, folder, "query_sample", "--sample_id", "3")
    assert "total_terms_used" in capsys.readouterr().out
    run(spark, folder, "export_samples", "--svm_file", str(folder / "out" / "svm"))
    assert len(lines(spark, folder, "svm")) == 24 and "0:" in lines(spark, folder, "svm")[0]
    run(spark, folder, "export_urls", name="unl")
    assert sum(",Normal" in x for x in lines(spark, folder, "urls")) == 28 and "w,None" in lines(spark, folder, "urls")
    run(spark, folder, "export_content")
    assert sum(x == "== Title ==" for x in lines(spark, folder, "content")) == 24
    run(spark, folder, "query_categories", name="unl")
    assert any(x.endswith(",18") for x in lines(spark, folder, "categories"))
    run(spark, folder, "query_keywords", name="unl")
    assert spark.read.text(str(folder / "out" / "keywords")).count() > 0


def test_learning_commands(spark, folder, capsys):
    sets = ("--positive_name", "pos", "--unlabeled_name", "unl")
    run(spark, folder, "pulearning", *sets)
    assert any("fraud" in x for x in lines(spark, folder, "keywords")) and len(lines(spark, folder, "train.svm")) == 48
    run(spark, folder, "iem", *sets)
    run(spark, folder, "sem", *sets)
    assert "p_recall" in capsys.readouterr().out
    run(spark, folder, "learn", *sets, "--test_name", "unl", "--hidden", "4")
    assert len(lines(spark, folder, "predictions")) == 41 and "Score:" in lines(spark, folder, "predictions")[0]
    run(spark, folder, "predict", "--model_dir", str(folder / "out"), name="unl")
    assert len(lines(spark, folder, "predictions")) == 37
    run(spark, folder, "train", "--test_name", "pos", name="unl")
    assert spark.read.option("header", True).csv(str(folder / "out" / "categories")).count() == 24


def test_curation_commands(spark, folder, monkeypatch):
    corpus = Corpus(spark, str(folder / "c"))
    monkeypatch.setattr(cli, "fetch", lambda url: (200, "fetched body"))
    run(spark, folder, "refresh", name="unl")
    assert corpus.samples("unl").filter("content = 'fetched body'").count() == 1
    (folder / "map.csv").write_text("cat1,cat2,new_cat1,new_cat2\nother,x,odd,y\n")
    run(spark, folder, "rebuild_categories", "--mapping_file", str(folder / "map.csv"), name="unl")
    assert corpus.samples("unl").filter("cat1 = 'odd' and cat2 = 'y'").count() == 18
    run(spark, folder, "purge", "--main_categories", "odd,neg", name="unl")
    assert corpus.samples("unl").count() == 36 and corpus.samples("pos").count() == 24


def test_settings(tmp_path):
    for name, value in (("a", "1"), ("b", "2")):
        (tmp_path / name).write_text(f"[global]\nx = {value}\n{name} = {name}\n")
    s = Settings([str(tmp_path / "a"), str(tmp_path / "b"), str(tmp_path / "none")])
    assert (s.get("x"), s.get("a"), s.get("c"), s.get("c", default="d")) == ("2", "a", None, "d")
    s.update("x", 3)
    s.update("a", None)
    s.write(str(tmp_path / "c"))
    again = Settings([str(tmp_path / "c")])
    assert (again.get("x"), again.get("a")) == ("3", "a")


def test_a_missing_option_is_said(spark, tmp_path):
    with pytest.raises(SystemExit, match="positive_name"):
        cli.main(["--corpus_dir", str(tmp_path), "iem"], spark, Settings(()))
