"""URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parameters that only track.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "mc_cid", "mc_eid", "mc_id", "referrer", "ref", "source", "campaign", "click_id")


def without_tracking(url: Column) -> Column:
    """The URL without tracking and empty parameters; an origin alone gets its slash."""
    drop = "|".join(TRACKING)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"^({drop})(=|$)") & ~p.rlike("^[^=]*=?$"))
    path = F.regexp_extract(url, r"^[^?#]*", 0)
    path = F.when(path.rlike("^[A-Za-z][A-Za-z0-9+.-]*://[^/]*$"), F.concat(path, F.lit("/"))).otherwise(path)
    tail = F.regexp_extract(url, "#.*$", 0)
    return F.concat(path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")), tail)


def normalize(url: Column, html: Column | None = None) -> Column:
    """Without one trailing slash, tracking and empty parameters; a differing canonical link wins."""
    plain = without_tracking(F.regexp_replace(url, "/$", ""))
    if html is None:
        return plain
    canonical = F.regexp_extract(html, r"""(?i)<link[^>]*rel=["']canonical["'][^>]*href=["']([^"']+)["']""", 1)
    other = without_tracking(canonical)
    return F.when((canonical != "") & (other != plain), F.regexp_replace(other, "/$", "")).otherwise(plain)


def _without_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments of an absolute path."""
    parts = F.split(path, "/")
    keep = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda out, p: F.when(p == ".", out).when(p == "..", F.slice(out, F.lit(1), F.greatest(F.lit(1), F.size(out) - 1))).otherwise(F.concat(out, F.array(p))),
    )
    ends = F.when(path.rlike(r"/\.{1,2}$"), F.lit("/")).otherwise(F.lit(""))
    return F.concat(F.array_join(keep, "/"), ends)


def resolve(value: Column, base: Column) -> Column:
    """Absolute URL of a reference on a base page: empty, absolute, ``//host``, ``/path``, ``?query``, ``#part`` and relative forms."""
    scheme = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    origin = F.regexp_extract(base, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0)
    page = F.regexp_extract(base, "^[^?#]*", 0)
    page = F.when(page == origin, F.concat(origin, F.lit("/"))).otherwise(page)
    folder = F.regexp_extract(page, "^(.*/)", 1)
    path = F.regexp_extract(value, "^[^?#]*", 0)
    tail = F.regexp_replace(value, "^[^?#]*", "")
    rooted = F.when(value.startswith("/"), path).otherwise(F.concat(F.substring(folder, F.length(origin) + 1, F.length(folder)), path))
    absolute = F.when(value.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*$"), F.concat(value, F.lit("/"))).otherwise(value)
    return (
        F.when(value.isNull() | (value == ""), base)
        .when(value.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), absolute)
        .when(value.startswith("//"), F.concat(scheme, F.lit(":"), value))
        .when(value.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), value))
        .when(value.startswith("?"), F.concat(page, value))
        .otherwise(F.concat(origin, _without_dots(rooted), tail))
    )


def origin(url: Column) -> Column:
    return F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0)


def path(url: Column) -> Column:
    found = F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(found == "", F.lit("/")).otherwise(found)
