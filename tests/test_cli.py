"""Periods from standard input."""

import json
import subprocess
import sys

import pytest

from millrace.__main__ import main, values


def test_values():
    assert values(["1", " 2.5 ", "", "x", "nan", "inf", "-3e1"]).tolist() == [1.0, 2.5, -30.0]


@pytest.mark.parametrize("method", ["acf", "fft", "autoperiod", "sazed", "single", "ensemble"])
def test_json(capsys, method):
    assert main(["--test", "--period", "12", "--noise", "0.1", "--method", method, "--json"]) == 0
    got = json.loads(capsys.readouterr().out)
    assert got["n"] == 240 and abs(got["period"] - 12) <= 1


def test_all_methods_and_range(capsys):
    assert main(["--test", "--period", "12", "--all-methods", "--min-period", "20", "--max-period", "30"]) == 0
    got = json.loads(capsys.readouterr().out)
    assert len(got) == 6 and all(20 <= p["period"] <= 30 for r in got for p in r["periods"])


def test_stdin():
    text = "\n".join(str(k % 7) for k in range(140))
    out = subprocess.run([sys.executable, "-m", "millrace", "--json"], input=text, capture_output=True, text=True, check=True, cwd=__file__.rsplit("/", 2)[0])
    assert json.loads(out.stdout)["period"] % 7 == 0
    assert subprocess.run([sys.executable, "-m", "millrace"], input="", capture_output=True, text=True, cwd=__file__.rsplit("/", 2)[0]).returncode == 1
