import json

from latora import cli

SMALL = ["--synthetic", "--synthetic-songs", "120"]


def test_recommend(spark, capsys):
    assert cli.main(["recommend", *SMALL, "--json", "--strategy", "all", "--explain", "-n", "3"]) == 0
    out = json.loads(capsys.readouterr().out)
    assert set(out["results"]) == set(cli.STRATEGIES) and out["model"]["k"] >= 1
    assert cli.main(["recommend", *SMALL, "--playlist", "zzzzzzzz qqq"]) == 1


def test_analyze_and_cluster(spark, capsys, tmp_path):
    assert cli.main(["analyze", *SMALL, "--save-model", str(tmp_path / "m")]) == 0
    assert "LF1" in capsys.readouterr().out and (tmp_path / "m").exists()
    assert cli.main(["cluster", *SMALL, "--clusters", "3", "--json"]) == 0
    assert "adjusted_rand_index" in json.loads(capsys.readouterr().out)
    assert cli.main(["cluster", *SMALL, "--label-column", "none"]) == 2


def test_errors(spark, capsys):
    assert cli.main(["analyze"]) == 2
    assert "--synthetic" in capsys.readouterr().err
    assert cli.main(["analyze", "--data", "/nowhere.csv"]) == 2
