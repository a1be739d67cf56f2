"""Column expressions for web addresses."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track visits.
TRACKING = r"^(utm_[^=]*|fbclid|gclid)(=|$)"
_PRIVATE = r"^(localhost|127\.\d+\.\d+\.\d+|10\.\d+\.\d+\.\d+|192\.168\.\d+\.\d+|169\.254\.\d+\.\d+|172\.(1[6-9]|2\d|3[01])\.\d+\.\d+|0\.0\.0\.0|\[?::1\]?)$"


def host(url: Column) -> Column:
    """The host in lower case, without port and closing dot; null where there is none."""
    h = F.regexp_extract(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.nullif(F.regexp_replace(h, r"\.$", ""), F.lit(""))


def canonical(url: Column) -> Column:
    """Scheme and host in lower case, default port, tracking parameters and fragment dropped; null for other schemes and private hosts."""
    u = F.trim(url)
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    port = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?[^/?#:]+:(\d+)", 1)
    path = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)), "&")
    h = host(u)
    default = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    built = F.concat(
        scheme, F.lit("://"), h, F.when(default, F.lit("")).otherwise(F.concat(F.lit(":"), port)), F.when(path == "", F.lit("/")).otherwise(path), F.when(kept == "", F.lit("")).otherwise(F.concat(F.lit("?"), kept))
    )
    return F.when(scheme.isin("http", "https") & h.isNotNull() & ~h.rlike(_PRIVATE), built)


def cleaned(url: Column) -> Column:
    """The address without parameters that are blank or begin with utm_, ref or trk, and without its fragment."""
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: p.rlike("=.") & ~F.lower(p).rlike("^(utm_|ref|trk)")), "&")
    return F.concat(F.regexp_extract(url, r"^[^?#]*", 0), F.when(kept == "", F.lit("")).otherwise(F.concat(F.lit("?"), kept)))


def joined(base: Column, link: Column) -> Column:
    """A link made whole against the address of its page; null for schemes other than http(s) and null links."""

    def run(bases: pd.Series, links: pd.Series) -> pd.Series:
        out = []
        for b, l in zip(bases, links):
            try:
                whole = urljoin(b, l.strip()) if b and l is not None else None
            except ValueError:
                whole = None
            out.append(whole if whole and whole.split(":", 1)[0].lower() in ("http", "https") else None)
        return pd.Series(out, dtype="object")

    return F.pandas_udf(run, "string")(base, link)


def links_in(script: Column) -> Column:
    """The http(s) addresses that a script or text mentions, each once, in order; escaped slashes are read as slashes."""
    plain = F.replace(script, F.lit("\\/"), F.lit("/"))
    return F.array_distinct(F.coalesce(F.regexp_extract_all(plain, F.lit(r"https?://[^\s\"'<>\\)\]}]+"), F.lit(0)), F.array().cast("array<string>")))


def content_type(header: Column, body: Column) -> Column:
    """The content type by the first bytes, else by the header without its parameters."""
    head = F.substring(body, 1, 5)
    stated = F.nullif(F.lower(F.trim(F.substring_index(header, ";", 1))), F.lit(""))
    low = F.lower(F.decode(F.substring(body, 1, 64), "ISO-8859-1"))
    return F.when(head == F.lit(bytearray(b"%PDF-")), "application/pdf").when(low.rlike(r"^\s*(<!doctype html|<html)"), "text/html").otherwise(stated)


def within(h: Column, domain: Column) -> Column:
    """The host is the domain or lies under it."""
    return (h == domain) | F.endswith(h, F.concat(F.lit("."), domain))
