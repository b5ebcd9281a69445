"""Semantic versions and requirements as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from provenio.functions.text import once

# The public grammar of semantic versions (semver.org) and the largest part a version may have.
LARGEST = 2**64 - 1
_NUMBER = "(?:0|[1-9][0-9]*)"
_IDENTIFIER = "(?:0|[1-9][0-9]*|[0-9]*[A-Za-z-][0-9A-Za-z-]*)"
_PRE = f"{_IDENTIFIER}(?:\\.{_IDENTIFIER})*"
_BUILD = "[0-9A-Za-z-]+(?:\\.[0-9A-Za-z-]+)*"


def _up_to(largest: int) -> str:
    """A pattern of the numbers from 0 to largest, without leading zeros."""
    digits = str(largest)
    shorter = f"[1-9][0-9]{{0,{len(digits) - 2}}}"
    below = [f"{digits[:k]}[{int(k == 0)}-{int(d) - 1}][0-9]{{{len(digits) - k - 1}}}" for k, d in enumerate(digits) if int(d) > int(k == 0)]
    return f"(?:{'|'.join(['0', *below, digits, shorter])})"


_IN_RANGE = _up_to(LARGEST)
VERSION = f"^{_IN_RANGE}\\.{_IN_RANGE}\\.{_IN_RANGE}(?:-{_PRE})?(?:\\+{_BUILD})?$"
_PART = f"{_NUMBER}|[*xX]"
COMPARATOR = f"^\\s*(=|>=|>|<=|<|~|\\^)?\\s*({_PART})(?:\\.({_PART})(?:\\.({_PART})(?:-({_PRE}))?(?:\\+{_BUILD})?)?)?\\s*$"
_SPACES = " \t\n\x0b\f\r\u0085\u2028\u2029"


def _number(text: Column) -> Column:
    """A number, null where the text is absent, a wildcard, or out of range."""
    number = text.try_cast("decimal(20,0)")
    return F.when(number <= F.lit(str(LARGEST)).cast("decimal(20,0)"), number)


def _core_and_pre(text: Column) -> tuple[Column, Column]:
    """Of a version without what stands before it: the parts between dots, and what stands between the first - and the +."""
    plain = F.substring_index(text, "+", 1)
    core = F.substring_index(plain, "-", 1)
    return core, F.substr(plain, F.char_length(core) + 2)


def _identifiers(pre: Column) -> Column:
    """Pre-release identifiers in an order that array comparison keeps: numbers first, by value."""
    parts = F.when(pre == "", F.array().cast("array<string>")).otherwise(F.split(pre, "\\."))
    return F.transform(
        parts,
        lambda p: F.struct(
            F.when(p.rlike("^[0-9]+$"), 0).otherwise(1).alias("kind"),
            F.when(p.rlike("^[0-9]+$"), F.char_length(p)).otherwise(0).alias("digits"),
            p.alias("text"),
        ),
    )


def semver_key(version: Column) -> Column:
    """struct(major, minor, patch, release, pre): compares as versions do; null unless a full x.y.z is given.

    A release sorts after its pre-releases; build metadata does not count. One pattern decides, ranges included; the
    parts are then cut out.
    """
    core, pre = _core_and_pre(F.rtrim(version, F.lit("\r\n\u0085\u2028\u2029")))
    part = lambda k: F.substring_index(F.substring_index(core, ".", k), ".", -1).try_cast("decimal(20,0)")
    key = F.struct(
        part(1).alias("major"),
        part(2).alias("minor"),
        part(3).alias("patch"),
        F.when(pre == "", 1).otherwise(0).alias("release"),
        _identifiers(pre).alias("pre"),
    )
    return F.when(version.rlike(VERSION), key)


def semver_or_text_key(text: Column) -> Column:
    """A sort key: valid versions first, by version; then other texts, by text. Descending turns it all around."""
    key = semver_key(text)
    return F.struct(
        key.isNull().alias("invalid"), key.alias("version"), F.when(key.isNull(), text).alias("text")
    )


def comparators(requirement: Column) -> Column:
    """array of struct(op, major, minor, patch, pre, release): null if any part does not parse.

    A bare comparator is a caret; a wildcard part ends the comparator and makes it a prefix match. A requirement
    of `*` alone has no comparators.
    """
    def cut(p: Column) -> Column:
        text = F.btrim(p, F.lit(_SPACES))
        op = F.regexp_extract(text, "^[=<>~^]*", 0)
        core, pre = _core_and_pre(F.ltrim(F.substr(text, F.char_length(op) + 1), F.lit(_SPACES)))
        return F.struct(op.alias("op"), F.split(core, "\\.").alias("parts"), pre.alias("pre"), p.rlike("\\.[*xX]").alias("wild"))

    def parsed(c: Column) -> Column:
        return F.struct(
            F.when(c["op"] != "", c["op"]).when(c["wild"], "*").otherwise("^").alias("op"),
            *[_number(F.get(c["parts"], F.lit(k))).alias(name) for k, name in enumerate(("major", "minor", "patch"))],
            F.struct(F.when(c["pre"] == "", 1).otherwise(0).alias("release"), _identifiers(c["pre"]).alias("pre")).alias("tail"),
        )

    def of_parts(parts: Column) -> Column:
        ok = F.forall(parts, lambda p: p.rlike(COMPARATOR) & ~p.rlike("^\\s*[*xX]") & ~p.rlike("[*xX]\\s*\\.\\s*[0-9]"))
        listed = F.when(ok, F.transform(parts, lambda p: once(cut(p), parsed)))
        return once(listed, lambda some: F.when(F.forall(some, lambda c: c["major"].isNotNull()), some))

    none = F.filter(F.transform(F.array(F.lit("")), lambda p: once(cut(p), parsed)), lambda c: F.lit(False))
    return once(F.btrim(requirement), lambda t: F.when(t.rlike("^[*xX]$"), none).otherwise(once(F.split(t, ","), of_parts)))


def _matches(c: Column, v: Column) -> Column:
    """Whether version key v meets comparator c, apart from the rule on pre-releases."""
    tail = F.struct(v["release"].alias("release"), v["pre"].alias("pre"))
    no_minor, no_patch = c["minor"].isNull(), c["patch"].isNull()
    same_major, same_minor, same_patch = (v[k] == c[k] for k in ("major", "minor", "patch"))
    exact = same_major & (no_minor | same_minor) & (no_patch | same_patch) & (no_patch | (tail == c["tail"]))

    def beyond(after) -> Column:
        """v stands after (or before) all that c covers, part by part."""
        return (
            F.when(~same_major, after(v["major"], c["major"]))
            .when(no_minor, False)
            .when(~same_minor, after(v["minor"], c["minor"]))
            .when(no_patch, False)
            .when(~same_patch, after(v["patch"], c["patch"]))
            .otherwise(after(tail, c["tail"]))
        )

    more, less = beyond(lambda a, b: a > b), beyond(lambda a, b: a < b)
    tilde = (
        F.when(~same_major | (~no_minor & ~same_minor), False)
        .when(~no_patch & ~same_patch, v["patch"] > c["patch"])
        .otherwise(no_patch | (tail >= c["tail"]))
    )
    stable = c["major"] > 0
    caret = (
        F.when(~same_major, False)
        .when(no_minor, True)
        .when(no_patch, F.when(stable, v["minor"] >= c["minor"]).otherwise(same_minor))
        .when(stable & ~same_minor, v["minor"] > c["minor"])
        .when(~same_minor, False)
        .when(~same_patch, (stable | (c["minor"] > 0)) & (v["patch"] > c["patch"]))
        .otherwise(tail >= c["tail"])
    )
    return (
        F.when(c["op"].isin("=", "*"), exact)
        .when(c["op"] == ">", more)
        .when(c["op"] == ">=", exact | more)
        .when(c["op"] == "<", less)
        .when(c["op"] == "<=", exact | less)
        .when(c["op"] == "~", tilde)
        .otherwise(caret)
    )


def _accepts(found: Column, v: Column) -> Column:
    """All comparators hold; a pre-release needs one with the same three parts and a pre-release of its own."""
    named = F.exists(
        found,
        lambda c: (c["tail"]["release"] == 0)
        & (c["major"] == v["major"])
        & (c["minor"] == v["minor"])
        & (c["patch"] == v["patch"]),
    )
    return F.forall(found, lambda c: _matches(c, v)) & ((v["release"] == 1) | named)


def _bound(requirement: Column, version: Column, body) -> Column:
    """body(comparators, key), each evaluated once."""
    pair = F.struct(comparators(requirement).alias("c"), semver_key(version).alias("v"))
    return once(pair, lambda s: body(s["c"], s["v"]))


def requirement_accepts(requirement: Column, version: Column) -> Column:
    """Whether the requirement accepts the version; null if either does not parse."""
    return _bound(requirement, version, lambda c, v: F.when(c.isNotNull() & v.isNotNull(), _accepts(c, v)))


def _pins(c: Column, v: Column) -> Column:
    one = F.get(c, F.lit(0))
    tail = F.struct(v["release"].alias("release"), v["pre"].alias("pre"))
    full = one["minor"].isNotNull() & one["patch"].isNotNull()
    same = (one["major"] == v["major"]) & (one["minor"] == v["minor"]) & (one["patch"] == v["patch"]) & (one["tail"] == tail)
    return F.coalesce((F.size(c) == 1) & (one["op"] == "=") & full & same, F.lit(False))


def explicit_exact_pin(requirement: Column, version: Column) -> Column:
    """Whether the requirement is one `=` comparator with all parts, equal to the version (build apart)."""
    return _bound(requirement, version, lambda c, v: F.when(c.isNotNull() & v.isNotNull(), _pins(c, v)))


def evaluate_requirement(requirement: Column, version: Column) -> Column:
    """struct(requirement, accepts, exact_pin, error): nulls and an error text where it does not parse."""
    found = _bound(
        requirement,
        version,
        lambda c, v: F.struct(
            F.when(c.isNotNull(), _accepts(c, v)).alias("accepts"),
            F.when(c.isNotNull(), _pins(c, v)).alias("exact_pin"),
            c.isNull().alias("bad"),
        ),
    )
    error = F.concat(F.lit("requirement does not parse: "), F.coalesce(requirement, F.lit("null")))
    return once(
        found,
        lambda f: F.struct(
            requirement.alias("requirement"), f["accepts"].alias("accepts"), f["exact_pin"].alias("exact_pin"), F.when(f["bad"], error).alias("error")
        ),
    )
