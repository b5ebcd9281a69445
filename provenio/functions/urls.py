"""Repository identities, URLs and paths as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from provenio.functions.text import ascii_lower, once

# First path segments of the code host that are pages of its own, not owners.
RESERVED_OWNERS = [
    "about", "codespaces", "collections", "enterprise", "explore", "features", "issues", "join", "login",
    "marketplace", "new", "notifications", "orgs", "pricing", "pulls", "search", "settings", "site", "sponsors",
    "topics", "users",
]
OWNER = "[A-Za-z0-9](?:[A-Za-z0-9-]{0,37}[A-Za-z0-9])?"
NAME = "[A-Za-z0-9_.-]{1,104}"
_HOSTED = "(?i)^(?:git\\+)?(https?|ssh|git)://(?:([^@/?#]*)@)?(www\\.github\\.com|github\\.com|api\\.github\\.com)\\.*(?::[0-9]*)?(/[^?#]*)?$"
_SCP = "(?i)^([^@]*)@github\\.com:(.*)$"
_HOST_OF = "(?i)^(?:git\\+)?([a-z][a-z0-9+.-]*)://(?:([^@/?#]*)@)?([^:/?#]+)"
REMOVED = "(repository URL with control characters removed)"


def _without_git(name: Column) -> Column:
    return F.regexp_replace(name, "\\.git$", "")


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "^\\s+", ""), "\\s+$", "")


def parse_repository(text: Column) -> Column:
    """struct(owner, name), or null where the text names no repository of the code host.

    Taken are git@host:owner/name and what follows, owner/name alone, and URLs of the host (https, http, ssh, git,
    with or without git+) or of its API's repos; not those with user information (but git@ over ssh or git), a query
    or a fragment, nor URLs of the host's own pages. Empty path segments do not count.
    """
    segments = lambda path: F.filter(F.split(path, "/"), lambda part: part != "")

    def of_url(h: Column) -> Column:
        allowed = (h["user"] == "") | ((h["user"] == "git") & h["scheme"].isin("ssh", "git"))
        first = ascii_lower(F.coalesce(F.get(h["path"], F.lit(0)), F.lit("")))
        api = h["host"] == "api.github.com"
        hosted = F.when(api & (first == "repos"), F.slice(h["path"], 2, 2)).when(~api & ~first.isin(*RESERVED_OWNERS), F.slice(h["path"], 1, 2))
        return F.when(allowed, hosted)

    def found(trimmed: Column) -> Column:
        """The segments of owner and name, or null where no form holds."""
        extract = lambda pattern, k: F.regexp_extract(trimmed, pattern, k)
        scp = once(extract(_SCP, 2), lambda path: F.when((extract(_SCP, 1) == "git") & ~path.rlike("[?#]"), segments(path)))
        url = F.struct(
            extract(_HOSTED, 2).alias("user"), F.lower(extract(_HOSTED, 1)).alias("scheme"), F.lower(extract(_HOSTED, 3)).alias("host"),
            segments(extract(_HOSTED, 4)).alias("path"),
        )
        return (
            F.when(trimmed.rlike(_SCP), scp)
            .when(~trimmed.contains("://"), once(segments(trimmed), lambda short: F.when(F.size(short) == 2, short)))
            .when(trimmed.rlike(_HOSTED), once(url, of_url))
        )

    def named(trimmed: Column) -> Column:
        pair = lambda parts: F.struct(F.get(parts, F.lit(0)).alias("owner"), _without_git(F.get(parts, F.lit(1))).alias("name"))
        valid = lambda p: (
            p["owner"].rlike(f"^{OWNER}$")
            & p["name"].rlike(f"^{NAME}$")
            & (F.char_length(p["name"]) <= 100)
            & ~p["name"].isin(".", "..")
            & ~trimmed.rlike("\\p{Cc}")
        )
        return once(once(found(trimmed), pair), lambda p: F.when(valid(p), p))

    return once(_trimmed(text), named)


def repository_key(text: Column) -> Column:
    """owner/name in ASCII lower case, or null."""
    parsed = parse_repository(text)
    return ascii_lower(F.concat(parsed["owner"], F.lit("/"), parsed["name"]))


def sensitive_url(text: Column) -> Column:
    """Whether a URL of the code host carries user information, a query or a fragment, even empty ones.

    In the form user@host:path any user but git, and a query or a fragment in the path, count.
    """
    trimmed = _trimmed(text)
    scp = (F.regexp_extract(trimmed, _SCP, 1) != "git") | F.regexp_extract(trimmed, _SCP, 2).rlike("[?#]")
    scheme, user, host = (F.lower(F.regexp_extract(text, _HOST_OF, k)) for k in (1, 2, 3))
    ours = F.regexp_replace(host, "\\.$", "").isin("github.com", "www.github.com", "api.github.com")
    has_user = text.rlike("^[^/]*://[^/?#]*@") & ~((user == "git") & scheme.isin("ssh", "git"))
    hosted = ours & (has_user | text.contains("?") | text.contains("#"))
    return F.coalesce(F.when(trimmed.rlike(_SCP), scp).otherwise(hosted), F.lit(False))


def sanitise_url(text: Column) -> Column:
    """A URL without user information, query and fragment; texts that are no URL stay."""
    bare = F.regexp_replace(F.regexp_replace(text, "[?#].*$", ""), "^([A-Za-z][A-Za-z0-9+.-]*://)[^/@]*@", "$1")
    return F.when(text.rlike("\\p{Cc}"), REMOVED).when(text.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), bare).otherwise(text)


def normalise_path(path: Column) -> Column:
    """Forward slashes, no empty or `.` parts, and `..` taken back where there is something to take back."""
    slashes = F.translate(path, "\\", "/")
    absolute = slashes.startswith("/")

    def step(done: Column, part: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        back = part == ".."
        return (
            F.when(part.isin("", "."), done)
            .when(back & (F.size(done) > 0) & (last != ".."), F.slice(done, 1, F.size(done) - 1))
            .when(back & absolute, done)
            .otherwise(F.concat(done, F.array(part)))
        )

    parts = F.aggregate(F.split(slashes, "/"), F.array().cast("array<string>"), step)
    return F.concat(F.when(absolute, "/").otherwise(""), F.array_join(parts, "/"))


def final_component(path: Column) -> Column:
    """What stands after the last slash."""
    return F.element_at(F.split(path, "/"), -1)


def directory(path: Column) -> Column:
    """What stands before the last slash; nothing if there is none."""
    return F.regexp_replace(F.regexp_extract(path, "^(.*)/[^/]*$", 1), "/$", "")


def ancestors(path: Column) -> Column:
    """The directory of a path and all above it, the longest first; the top is the empty text."""
    parts = F.filter(F.split(directory(path), "/"), lambda p: p != "")
    return F.transform(
        F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")
    )


def index_path(name: Column) -> Column:
    """Where a package's file is in the registry's index; an error for names it cannot hold."""
    lower = ascii_lower(name)
    size = F.char_length(lower)
    path = (
        F.when(size == 1, F.concat(F.lit("1/"), lower))
        .when(size == 2, F.concat(F.lit("2/"), lower))
        .when(size == 3, F.concat(F.lit("3/"), F.substring(lower, 1, 1), F.lit("/"), lower))
        .otherwise(F.concat_ws("/", F.substring(lower, 1, 2), F.substring(lower, 3, 2), lower))
    )
    return F.when(name.rlike("^[A-Za-z0-9_-]+$"), path).otherwise(
        F.raise_error(F.concat(F.lit("not a package name: "), F.coalesce(name, F.lit("null"))))
    )
