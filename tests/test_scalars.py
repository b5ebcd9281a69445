"""Scalar functions against truth tables."""

import pytest
from pyspark.sql import functions as F

from provenio.functions import semver, text, urls


def values(spark, inputs, build, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(build(F.col("v"))).collect()]


def test_requirements_against_a_version(spark):
    cases = {
        "1.2.3": (True, False), "^1.0": (True, False), "1.3": (False, False), "=1.2.3": (True, True), "=1.2": (True, False),
        "~1.2.0": (True, False), "~1": (True, False), ">=1.2.3, <2": (True, False), "<1.2.3": (False, False), ">1.2": (False, False),
        "<=1.2": (True, False), "*": (True, False), "1.*": (True, False), "1.3.*": (False, False), "0.2.3": (False, False),
        "=1.2.3+build": (True, True), "=1.2.3, <2": (True, False), "garbage": (None, None), "01.2.3": (None, None), "": (None, None),
    }
    df = spark.createDataFrame([(k,) for k in cases], "r string")
    rows = df.select("r", semver.evaluate_requirement(F.col("r"), F.lit("1.2.3")).alias("e")).collect()
    assert {r.r: (r.e.accepts, r.e.exact_pin) for r in rows} == cases
    assert all((r.e.error is None) == (r.e.accepts is not None) for r in rows)


def test_prereleases_need_a_comparator_of_their_own(spark):
    def check(requirement, version):
        df = spark.range(1).select(
            semver.requirement_accepts(F.lit(requirement), F.lit(version)), semver.explicit_exact_pin(F.lit(requirement), F.lit(version))
        )
        return tuple(df.first())

    assert check("^1.2.3", "1.2.4-rc.1") == (False, False)
    assert check("^1.2.4-rc.1", "1.2.4-rc.2") == (True, False)
    assert check("=1.2.4-rc.1", "1.2.4-rc.1") == (True, True)
    assert check("^0.0.3", "0.0.4") == (False, False)
    assert check("^0.2", "0.2.9") == (True, False)


def test_version_order_and_invalid_texts(spark):
    ordered = ["1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "1.0.0", "1.0.1", "1.10.0", "18446744073709551615.0.0", "1.70", "18446744073709551616.0.0", "x"]
    df = spark.createDataFrame([(v,) for v in reversed(ordered)], "v string")
    key = semver.semver_or_text_key(F.col("v"))
    assert [r.v for r in df.orderBy(key).collect()] == ordered
    assert [r.v for r in df.orderBy(key.desc()).collect()][:3] == ["x", "18446744073709551616.0.0", "1.70"]


def test_repository_identities(spark):
    cases = {
        "https://github.com/a/b": "a/b", " git@github.com:A/b.git ": "a/b", "a/b": "a/b", "git+ssh://git@github.com/a/b": "a/b",
        "https://github.com./a/b/tree/main": "a/b", "https://api.github.com/repos/a/b": "a/b", "https://github.com/a/b?x=1": None,
        "https://github.com/a/b#": None, "https://u:p@github.com/a/b": None, "https://github.com/topics/b": None, "https://gitlab.com/a/b": None,
        "a/b/c": None, "-a/b": None, "a/..": None, "": None, "a/b\n\x01": None, "https://github.com/a": None, None: None,
    }
    assert values(spark, list(cases), urls.repository_key) == list(cases.values())


def test_sensitive_and_sanitised_urls(spark):
    cases = {
        "https://u:p@github.com/a/b": True, "https://github.com/a/b?": True, "https://github.com/a/b#": True, "ssh://git@github.com/a/b": False,
        "https://github.com/a/b": False, "https://u:p@example.org/a?x": False, "nonsense": False, None: False,
    }
    assert values(spark, list(cases), urls.sensitive_url) == list(cases.values())
    assert values(spark, ["https://u:p@h/x?y#z", "no url?", "a\x07b"], urls.sanitise_url) == ["https://h/x", "no url?", urls.REMOVED]


def test_paths(spark):
    cases = {"a\\b/./c//d": "a/b/c/d", "a/../../b": "../b", "/../a": "/a", "": "", "../..": "../..", "a/..": ""}
    assert values(spark, list(cases), urls.normalise_path) == list(cases.values())
    assert values(spark, ["a/b/c", "c", "a/"], urls.final_component) == ["c", "c", ""]
    assert values(spark, ["a/b/c", "c"], urls.ancestors) == [["a/b", "a", ""], [""]]
    assert values(spark, ["A", "ab", "Abc", "abcd", "a-b_c"], urls.index_path) == ["1/a", "2/ab", "3/a/abc", "ab/cd/abcd", "a-/b_/a-b_c"]
    with pytest.raises(Exception, match="not a package name"):
        values(spark, ["a b"], urls.index_path)


def test_cells_and_encodings(spark):
    assert values(spark, ["=1", "＋x", "\tx", "x=1", "", None], text.csv_safe) == ["'=1", "'＋x", "'\tx", "x=1", "", None]
    assert values(spark, ["a|b`c\r\nd"], text.markdown_cell) == ["a\\|b\\`c d"]
    good = {"": "", "Zg==": "f", " Z m 8 =\n": "fo", "Zm9v": "foo"}
    assert values(spark, list(good), lambda c: text.base64_strict(c).cast("string")) == list(good.values())
    assert values(spark, ["Zh==", "Zg", "Zg=", "Z=g=", "Zm9v=", "é"], text.base64_strict) == [None] * 6
    assert values(spark, ["a.b*c/d"], text.pattern_escape) == ["a\\.b\\*c\\/d"]
    assert values(spark, ["rust-x", "x_rs", "rust_x-rs", "rustx"], text.strip_language_affixes) == ["x", "x", "x", "rustx"]
    assert values(spark, ["abc"], text.search_terms) == [["ab", "abc", "ac", "bc"]]


def test_jaro_winkler_published_examples():
    assert text.jaro_winkler_text("MARTHA", "MARHTA") == pytest.approx(0.9611, abs=1e-4)
    assert text.jaro_winkler_text("DIXON", "DICKSONX") == pytest.approx(0.8133, abs=1e-4)
    assert text.jaro_winkler_text("DWAYNE", "DUANE") == pytest.approx(0.84, abs=1e-4)
    assert text.jaro_winkler_text("", "a") == 0.0 and text.jaro_winkler_text("", "") == 1.0


def test_a_version_is_matched_once(spark):
    """One pattern decides a version, its ranges too, and nothing matches it again."""
    plan = spark.range(1).select(semver.semver_key(F.col("id").cast("string")))._jdf.queryExecution().analyzed().toString()
    assert plan.count("RLIKE(cast(id") == 1 and "regexp_extract" not in plan
    texts = ["1.2.3", "1.2.18446744073709551615", "1.2.18446744073709551616", "1.99999999999999999999.0", "123456789012345678901.0.0", "1.2.3-rc.1+b-1", "1.2.3+b-1", "01.2.3"]
    found = values(spark, texts, lambda v: F.to_json(F.struct(semver.semver_key(v).alias("k"))))
    whole = '{"k":{"major":1,"minor":2,"patch":%s,"release":%d,"pre":%s}}'
    identifiers = '[{"kind":1,"digits":0,"text":"rc"},{"kind":0,"digits":1,"text":"1"}]'
    assert found == [whole % (3, 1, "[]"), whole % (2**64 - 1, 1, "[]"), "{}", "{}", "{}", whole % (3, 0, identifiers), whole % (3, 1, "[]"), "{}"]


def test_repositories_and_requirements_are_parsed_once(spark):
    """Each of the two is bound before it is used: patterns stand in the plan a few times, not hundreds."""
    text = F.col("id").cast("string")
    plan = lambda c: spark.range(1).select(c)._jdf.queryExecution().analyzed().toString().lower()
    for column, most in ((urls.parse_repository(text), 60), (semver.evaluate_requirement(text, F.lit("1.2.3")), 60)):
        shown = plan(column)
        assert shown.count("regexp_") + shown.count("rlike") <= most
