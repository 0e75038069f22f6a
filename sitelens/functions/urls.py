"""URL column expressions (regex based, so invalid URLs never raise).

``parse_url`` raises on some malformed URLs and drops the port, while the
semantics we need follow a lenient ``scheme://netloc/path?query#fragment``
split with the netloc kept whole (port included).  Everything here is a
native Column expression so it stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# scheme? //netloc? path ?query #fragment  (lenient split, never raises)
_URL_RX = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def url_scheme(url) -> Column:
    return F.lower(F.regexp_extract(_c(url), _URL_RX, 1))


def url_netloc(url) -> Column:
    """netloc lower-cased, port kept (empty for relative URLs)."""
    return F.lower(F.regexp_extract(_c(url), _URL_RX, 2))


def url_path(url) -> Column:
    return F.regexp_extract(_c(url), _URL_RX, 3)


def url_query(url) -> Column:
    return F.regexp_extract(_c(url), _URL_RX, 4)


def host_of(netloc) -> Column:
    """Host part of a netloc: text before the first ':' (the port is dropped)."""
    return F.split_part(_c(netloc), F.lit(":"), F.lit(1))


def url_host(url) -> Column:
    return host_of(url_netloc(url))


def is_absolute_http(url) -> Column:
    u = _c(url)
    return u.startswith("http://") | u.startswith("https://")


def normalize_path(url) -> Column:
    """Path only, collapse '//' runs, strip trailing '/', empty -> '/'."""
    p = F.regexp_replace(url_path(url), "/{2,}", "/")
    p = F.when(F.length(p) > 1, F.regexp_replace(p, "/+$", "")).otherwise(p)
    return F.when(p == "", F.lit("/")).otherwise(p)


def strip_www(host) -> Column:
    h = _c(host)
    return F.when(h.startswith("www."), F.substring(h, 5, 1 << 30)).otherwise(h)


def apex_domain(host, variant: str = "full") -> Column:
    """J6 apex heuristic over a host (or netloc) column.

    variant ``full``: IPv4 kept whole; last 3 labels when the second-last label
    has <= 3 chars and the TLD has 2 chars; else last 2.
    variant ``noip``: as ``full`` without the IPv4 case.
    variant ``last2``: always the last two labels.
    """
    h = host_of(F.lower(_c(host)))
    parts = F.split(h, r"\.")
    n = F.size(parts)
    last2 = F.when(n >= 2, F.array_join(F.slice(parts, -2, 2), ".")).otherwise(h)
    if variant == "last2":
        return last2
    three = (n >= 3) & (F.length(F.element_at(parts, -2)) <= 3) & (F.length(F.element_at(parts, -1)) == 2)
    out = F.when(three, F.array_join(F.slice(parts, -3, 3), ".")).otherwise(last2)
    if variant == "noip":
        return out
    ipv4 = (n == 4) & F.forall(parts, lambda p: p.rlike("^[0-9]+$"))
    return F.when(ipv4, h).otherwise(out)


def first_party(host1, host2) -> Column:
    """Hosts equal after dropping port and 'www.', or the same apex."""
    h1 = strip_www(host_of(F.lower(_c(host1))))
    h2 = strip_www(host_of(F.lower(_c(host2))))
    return (h1 == h2) | (apex_domain(h1) == apex_domain(h2))


def _without_dots(path: Column) -> Column:
    """A path with its ``.`` and ``..`` segments resolved."""
    parts = F.split(path, "/")
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, s: (
        F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(s == ".", acc).otherwise(F.concat(acc, F.array(s)))))
    kept = F.array_join(F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/")
    kept = F.when(kept.startswith("/"), kept).otherwise(F.concat(F.lit("/"), kept))
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), kept).otherwise(path)


def resolve_url(base, ref) -> Column:
    """The reference resolved against the base (RFC 3986 section 5.2): scheme, network path, dot segments, query and fragment.

    A reference with a scheme of its own stands as it is; one with the base's scheme and no host counts as relative.
    Control characters and blanks around the reference, and tabs and line breaks in it, are dropped.
    """
    b = _c(base)
    r = F.regexp_replace(F.translate(_c(ref), "\t\r\n", ""), r"\A[\x00-\x20]++", "")
    r = F.trim(r, F.lit(" \x0b\x0c"))
    scheme, host, base_path = url_scheme(b), F.regexp_extract(b, _URL_RX, 2), url_path(b)
    own = url_scheme(r)
    rest = F.regexp_replace(r, r"\A[A-Za-z][A-Za-z0-9+.\-]*+:", "")  # without the scheme
    tail = F.when(own != "", rest).otherwise(r)
    path, after = F.regexp_extract(tail, r"(?s)\A([^?#]*+)(.*)\z", 1), F.regexp_extract(tail, r"(?s)\A([^?#]*+)(.*)\z", 2)
    origin = F.concat(scheme, F.lit("://"), host)
    folder = F.regexp_replace(base_path, r"[^/]*+\z", "")
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    query = F.regexp_extract(b, r"(?s)\A[^?#]*+(\?[^#]*+)?+", 1)
    return (
        F.when((own != "") & (own != scheme), r)
        .when(tail.startswith("//"), F.concat(scheme, F.lit(":"), tail))
        .when(tail == "", b)
        .when((path == "") & after.startswith("#"), F.concat(origin, base_path, query, after))
        .when(path == "", F.concat(origin, base_path, after))
        .when(path.startswith("/"), F.concat(origin, _without_dots(path), after))
        .otherwise(F.concat(origin, _without_dots(F.regexp_replace(F.concat(folder, path), "/{2,}", "/")), after))
    )
