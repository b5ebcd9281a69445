"""Names, cells and encodings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a spreadsheet takes for the start of a formula.
FORMULA_STARTS = "=+\\-@\\t\\r\\n＝＋－＠"
# Characters with a meaning of their own in search patterns.
PATTERN_SPECIALS = "([.+*?^$()\\[\\]{}|\\\\/])"


def once(value: Column, body) -> Column:
    """body(value), with value evaluated a single time however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def canonical_name(name: Column) -> Column:
    """ASCII lower case, with hyphens as underscores."""
    return F.translate(name, "ABCDEFGHIJKLMNOPQRSTUVWXYZ-", "abcdefghijklmnopqrstuvwxyz_")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def strip_language_affixes(name: Column) -> Column:
    """One language prefix and one language suffix taken off."""
    return F.regexp_replace(F.regexp_replace(name, "^rust[-_]", ""), "[-_]rs$", "")


def search_terms(query: Column) -> Column:
    """The terms to search for, as a sorted set: the query, its stems, and for short ones some deletions."""
    lower = F.lower(query)
    size = F.char_length(lower)

    def without(at: Column) -> Column:
        left = F.concat(F.substring(lower, F.lit(1), at), F.substring(lower, at + 2, size))
        return F.when((size >= 3) & (size <= 12) & (F.octet_length(left) >= 2), left)

    terms = F.array(
        query,
        F.regexp_replace(lower, "-rs$", ""),
        F.regexp_replace(lower, "^rust-", ""),
        without(F.lit(0)),
        without(F.floor(size / 2).cast("int")),
        without(size - 1),
    )
    return F.array_sort(F.array_distinct(F.filter(terms, lambda t: t.isNotNull() & (t != ""))))


def csv_safe(text: Column) -> Column:
    """A cell that no spreadsheet reads as a formula."""
    return F.when(text.rlike(f"^[{FORMULA_STARTS}]"), F.concat(F.lit("'"), text)).otherwise(text)


def json_cell(value: Column) -> Column:
    """Compact JSON that keeps nulls."""
    return F.to_json(value, {"ignoreNullFields": "false"})


def markdown_cell(text: Column) -> Column:
    """A cell of a Markdown table: bars and backticks escaped, line breaks as spaces."""
    return F.regexp_replace(F.regexp_replace(text, "([|`])", "\\\\$1"), "\\r?\\n|\\r", " ")


def pattern_escape(text: Column) -> Column:
    """Text that stands for itself in a search pattern."""
    return F.regexp_replace(text, PATTERN_SPECIALS, "\\\\$1")


def form_encode(text: Column) -> Column:
    """application/x-www-form-urlencoded."""
    return F.url_encode(text)


def encode_path_segment(text: Column) -> Column:
    """Percent-encoding of a path segment: a space is %20, and the unreserved characters stay."""
    return F.regexp_replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")), "\\*", "%2A")


def base64_strict(text: Column) -> Column:
    """Decoded bytes; null unless whole quads, padding at the end only, and no stray bits (white space aside)."""
    compact = F.regexp_replace(text, "[ \\t\\r\\n\\f\\x0B]", "")
    shaped = compact.rlike("^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$")
    data = F.try_to_binary(compact, F.lit("base64"))
    again = F.regexp_replace(F.base64(data), "[\\r\\n]", "")
    return F.when(shaped & (again == compact), data)


def excerpt(text: Column, most: int = 512) -> Column:
    """The start of a text, for error messages."""
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def _jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used = [False] * len(b)
    mine = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                mine.append(c)
                break
    if not mine:
        return 0.0
    other = [c for c, u in zip(b, used) if u]
    swaps = sum(x != y for x, y in zip(mine, other)) // 2
    m = len(mine)
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def jaro_winkler_text(a: str, b: str) -> float:
    """Jaro-Winkler similarity of two texts on the driver: a common prefix of up to four characters adds to a Jaro similarity over 0.7."""
    base = _jaro(a, b)
    if base <= 0.7:
        return base
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return base + prefix * 0.1 * (1 - base)


def _bound(value: Column, body) -> Column:
    """body(v) with v evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def jaro(a: Column, b: Column) -> Column:
    """Jaro similarity by a fold over the code points of a: each takes the first equal one of b that is near enough and
    still free. Half of the matched pairs that stand in another order, rounded down, count as transpositions."""

    def compared(pair: Column) -> Column:
        x, y, reach = pair["a"], pair["b"], pair["reach"]
        start = F.struct(F.transform(y, lambda c: F.when(c != "", c)).alias("free"), F.array().cast("array<string>").alias("mine"))

        def step(state: Column, i: Column) -> Column:
            c = F.get(x, i)
            near = F.filter(F.sequence(F.lit(0), F.size(y) - 1), lambda j: (j >= i - reach) & (j <= i + reach) & F.coalesce(F.get(state["free"], j) == c, F.lit(False)))
            at = F.coalesce(F.get(near, F.lit(0)), F.lit(-1))
            return F.struct(
                F.transform(state["free"], lambda v, k: F.when(k != at, v)).alias("free"),
                F.when(at >= 0, F.concat(state["mine"], F.array(c))).otherwise(state["mine"]).alias("mine"),
            )

        def score(state: Column) -> Column:
            theirs = F.array_compact(F.transform(y, lambda c, k: F.when(F.get(state["free"], k).isNull(), c)))
            odd = F.size(F.filter(F.zip_with(state["mine"], theirs, lambda p, q: p != q), lambda different: different))
            m = F.size(state["mine"]).cast("double")
            return F.when(m == 0, F.lit(0.0)).otherwise((m / F.size(x) + m / F.size(y) + (m - F.floor(odd / 2)) / m) / 3)

        return F.aggregate(F.sequence(F.lit(0), F.size(x) - 1), start, step, score)

    reach = F.greatest(F.floor(F.greatest(F.char_length(a), F.char_length(b)) / 2) - 1, F.lit(0))
    pair = F.struct(F.split(a, "").alias("a"), F.split(b, "").alias("b"), reach.cast("int").alias("reach"))
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).when(a.isNotNull() & b.isNotNull(), _bound(pair, compared))


def _with_prefix(base: Column, a: Column, b: Column) -> Column:
    """A common prefix of up to four characters adds to a similarity over 0.7."""
    same = lambda k: F.when((F.char_length(a) >= k) & (F.char_length(b) >= k) & (F.substring(a, 1, k) == F.substring(b, 1, k)), k).otherwise(0)
    prefix = F.greatest(*[same(k) for k in range(1, 5)])
    return _bound(base, lambda x: F.when(x > 0.7, x + prefix * 0.1 * (1 - x)).otherwise(x))


def jaro_winkler(a: Column, b: Column) -> Column:
    """Jaro-Winkler similarity, 0 to 1, in the JVM; null where a text is. It is a fold, of length times length: compare few."""
    return _with_prefix(jaro(a, b), a, b)


def jaro_winkler_bound(text: str, b: Column) -> Column:
    """What the Jaro-Winkler similarity with a given text is at most: as if every character that both have, as often as
    both have it, were matched in order. Cheap: a replacement per distinct character of the text."""
    if not text:
        return jaro_winkler(F.lit(text), b)
    length = F.char_length(b)
    shared = [F.least(F.lit(text.count(c)), length - F.char_length(F.replace(b, F.lit(c), F.lit("")))) for c in sorted(set(text))]
    m = sum(shared[1:], shared[0]).cast("double")
    base = F.when(b == text, 1.0).when(m == 0, 0.0).otherwise((m / len(text) + m / length + 1) / 3)
    return F.when(b.isNotNull(), _with_prefix(base, F.lit(text), b))
