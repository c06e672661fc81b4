"""URL functions as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwell.functions.text import only_where, unescape_html

# Parameters that don't tell pages apart.
PAGE_TRACKING = r"^(utm_[^=]*|ref|ref_src|source|spm|fbclid|gclid|mc_cid)(=|$)"


def page_key(url: Column) -> Column:
    """One form of all addresses of a page: without `www.`, default port, doubled and trailing slashes, fragment and tracking
    parameters, the host in lower case and the parameters in order. Null where there is no address with a host."""
    u = F.trim(url)
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1))
    host = F.regexp_replace(F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)), r"^www\.", "")
    host = F.when(scheme == "https", F.regexp_replace(host, ":443$", "")).when(scheme == "http", F.regexp_replace(host, ":80$", "")).otherwise(host)
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(u, r"^[^?#]*?://[^/?#]*([^?#]*)", 1), "/{2,}", "/"), "/$", "")
    query = F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1)
    params = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(PAGE_TRACKING))), "&")
    return F.when(host != "", F.concat(scheme, F.lit("://"), host, path, F.when(params != "", F.concat(F.lit("?"), params)).otherwise("")))


# Parameters that a canonical address leaves out besides those beginning with utm_.
TRACKING = ["fbclid", "gclid", "mc_cid", "mc_eid", "ref", "ref_src", "source", "spm"]


def hostname(url: Column) -> Column:
    """The host in lower case without `www.`; '' if there is none."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.regexp_replace(host, r"^www\.", "")


def domain_allowed(url: Column, domains: Column) -> Column:
    """Whether the host is one of the domains or below one."""
    host = hostname(url)

    def matches(d: Column) -> Column:
        domain = F.regexp_replace(F.lower(d), r"^www\.", "")
        return (host == domain) | F.endswith(host, F.concat(F.lit("."), domain))

    return F.coalesce(F.exists(domains, matches) & (host != ""), F.lit(False))


# The hosts of a paper archive, whose abstracts, files and versions are one page, and that page's address.
PAPER_HOSTS = ["arxiv.org", "export.arxiv.org"]
PAPER_PAGE = "https://arxiv.org/abs/"


def _reencoded(part: Column) -> Column:
    """A part of a query decoded and encoded again, so that equal values are written alike."""
    plain = F.coalesce(F.try_url_decode(part), part)
    return F.replace(F.replace(F.url_encode(plain), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical_url(url: Column) -> Column:
    """The canonical form of an address: lower host without `www.`, no default port, fragment, user or tracking
    parameters, single slashes, none at the end, parameters decoded, in order and written alike, blank ones gone; https where no scheme is
    given. All addresses of a paper (abstract, file, any version) have that of its abstract. Null is ''."""
    u = F.trim(F.coalesce(url, F.lit("")))
    u = F.trim(only_where(u.rlike("&[#A-Za-z]"), unescape_html, u))
    u = F.when(u.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), u).when(F.startswith(u, F.lit("//")), F.concat(F.lit("https:"), u)).when(u != "", F.concat(F.lit("https://"), u)).otherwise("")
    scheme = F.lower(F.regexp_extract(u, "^([^:]+)://", 1))
    authority = F.lower(F.regexp_extract(u, "^[^:]+://(?:[^/?#]*@)?([^/?#]*)", 1))
    host = F.regexp_replace(F.regexp_replace(authority, ":[0-9]*$", ""), r"^www\.", "")
    port = F.regexp_extract(authority, ":0*([0-9]*)$", 1)
    usual = (port == "") | ((scheme == "https") & (port == "443")) | ((scheme == "http") & (port == "80"))
    path = F.regexp_replace(F.concat(F.lit("/"), F.regexp_extract(u, "^[^:]+://[^/?#]*([^?#]*)", 1)), "/+", "/")
    paper = F.regexp_replace(F.regexp_extract(path, "/(?:abs|pdf)/([^/]+)", 1), r"(?i:\.pdf)?$", "")
    paper = F.regexp_replace(paper, "v[0-9]+$", "")
    # a parameter as (name, value): the order of parameters is that of the pairs
    pairs = F.transform(
        F.filter(F.split(F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1), "&"), lambda p: p.rlike("^[^=]*=.+$")),
        lambda p: F.struct(_reencoded(F.regexp_extract(p, "^([^=]*)=", 1)).alias("name"), _reencoded(F.regexp_extract(p, "^[^=]*=(.*)$", 1)).alias("value")),
    )
    kept = F.filter(pairs, lambda p: ~F.lower(p["name"]).isin(TRACKING) & ~F.startswith(F.lower(p["name"]), F.lit("utm_")))
    query = F.array_join(F.transform(F.array_sort(kept), lambda p: F.concat(p["name"], F.lit("="), p["value"])), "&")
    page = F.concat(scheme, F.lit("://"), host, F.when(usual, "").otherwise(F.concat(F.lit(":"), port)), F.when(path == "/", path).otherwise(F.regexp_replace(path, "/$", "")), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(u == "", "").when(host.isin(PAPER_HOSTS) & (paper != ""), F.concat(F.lit(PAPER_PAGE), paper)).otherwise(page)
