"""Many rules at once against the plain loop, and the texts that patterns require."""

import random
import re

import pytest

from logweave.functions.literals import required_texts
from logweave.operators import rules as rule_ops
from logweave.sources.rules import FLAT


@pytest.mark.parametrize(
    ("pattern", "want"),
    [
        ("deauth", {"deauth"}), ("rx_err=[1-9]", {"rx_err="}), ("a|bc", {"a", "bc"}), ("(?:up|down) link", {" link"}), ("(abc)+d?", {"abc"}), ("x{0,3}yz", {"yz"}),
        (r"\d+ lost\.", {" lost."}), (r"^\[ok\] go", {"[ok] go"}), ("(?i)Error X", {"error x"}),
    ],
)
def test_required_texts(pattern, want):
    assert required_texts(pattern)[0] == want


@pytest.mark.parametrize("pattern", ["", ".*", "[a-z]+", "a?", "a|.", "(", "(?!x)y|z", "(?s).", "x*|y", "(?i)é"])
def test_patterns_that_require_nothing(pattern):
    assert required_texts(pattern) is None


def test_ten_thousand_rules_equal_the_loop(spark):
    r = random.Random(4)
    words = [f"{a}{b}{k}" for a in "abcd" for b in "xyz" for k in range(300)]
    rules = []
    for k in range(10_000):
        w, v = r.choice(words), r.choice(words)
        pattern = r.choice([w, f"^{w} ", f"{w}|{v}", f"{w} .*{v}", f"(?i){w.upper()}", f"[ab]{w[1:]}", f"{w}\\d+", f"({w})+$", f"(?<!q){w}", "[zq]{3}"]) if k % 1000 else r.choice(["(?=z)z0", r"\bq+\b"])
        rules.append((f"c{k}", "t", "", "F.log", r.choice(["one", "two"]), "STD", pattern, ""))
    lines = [(f, k, " ".join(r.choice(words) for _ in range(r.randrange(12))) if k % 17 else None) for f in ("One.log", "two.txt", "other") for k in range(150)]
    found = rule_ops.apply_rules(spark.createDataFrame(lines, "file string, line_no bigint, line string"), spark.createDataFrame(rules, FLAT), cap=5, samples=2)
    want = {}
    for key, file in (("one", "One.log"), ("two", "two.txt")):
        of = [x for f, _, x in lines if f == file and x is not None]
        for c, *_, key_, _, pattern, _ in rules:
            if key_ == key and (hits := [x for x in of if re.search(pattern, x)]):
                want[(c, file)] = (min(5, len(hits)), hits[:2])
    assert len(want) > 1000
    assert {(x.Category, x.FileName): (x.Frequency, x.SampleLogs) for x in found.collect()} == want


def test_more_rules_than_allowed(spark, monkeypatch):
    monkeypatch.setattr(rule_ops, "MAX_TEXT_CHARS", 10)
    monkeypatch.setattr(rule_ops, "PLAIN_RULES", 1)
    rules = spark.createDataFrame([("c", "t", "", "f", "f", "STD", p, "") for p in ("abcdef", "ghijkl")], FLAT)
    with pytest.raises(ValueError, match="characters"):
        rule_ops.apply_rules(spark.createDataFrame([("f", 1, "x")], "file string, line_no bigint, line string"), rules)
