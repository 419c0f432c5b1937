"""URL and address predicates as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ranges that no public host has.
_PRIVATE_HOST = r"^(localhost|127\.0\.0\.1|0\.0\.0\.0|::1|\[::1\])$|\.(local|internal)$|^10\.|^192\.168\.|^172\.(1[6-9]|2[0-9]|3[01])\.|^169\.254\."


def host_of(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def safe_http(url: Column) -> Column:
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))).isin("http", "https"), F.lit(False))


def url_decision(url: Column, allowed: Sequence[str]) -> Column:
    """ok, malformed, scheme, private or not_listed."""
    host = host_of(url)
    listed = F.lit(False)
    for a in allowed:
        listed = listed | (host == a) | host.endswith("." + a)
    scheme = F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))
    return F.when(scheme.isNull() | host.isNull(), "malformed").when(~scheme.isin("http", "https"), "scheme").when(host.rlike(_PRIVATE_HOST), "private").when(~listed, "not_listed").otherwise("ok")


def private_v4(ip: Column) -> Column:
    """Whether a dotted address is in a private or reserved range."""
    octet = lambda i: F.try_element_at(F.split(ip, r"\."), F.lit(i)).cast("int")
    a, b = octet(1), octet(2)
    valid = ip.rlike(r"^((25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$")
    inside = a.isin(0, 10, 127) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & b.isin(0, 168)) | ((a == 198) & b.between(18, 19)) | (a >= 224)
    return F.when(valid, inside).otherwise(False)


def private_v6(ip: Column) -> Column:
    """Whether an address of version 6, in brackets or not, is loopback,
    unspecified, local, multicast, or a private address of version 4 in disguise."""
    t = F.lower(F.regexp_replace(ip, r"^\[|\]$", ""))
    tail = F.regexp_extract(t, r"^::ffff:((?:\d{1,3}\.){3}\d{1,3})$", 1)
    part = lambda group, at: F.conv(F.substring(F.lpad(F.regexp_extract(t, "^::ffff:([0-9a-f]{1,4}):([0-9a-f]{1,4})$", group), 4, "0"), at, 2), 16, 10)
    hexed = t.rlike("^::ffff:[0-9a-f]{1,4}:[0-9a-f]{1,4}$")
    dotted = F.when(hexed, F.concat_ws(".", part(1, 1), part(1, 3), part(2, 1), part(2, 3))).otherwise(tail)
    groups = F.size(F.filter(F.split(t, ":"), lambda g: g != ""))
    short = (F.regexp_count(t, F.lit("::")) == 1) & ~t.contains(":::") & (groups <= 7)
    plain = t.rlike("^[0-9a-f]{0,4}(:[0-9a-f]{0,4})+$") & (short | (~t.contains("::") & (groups == 8) & (F.regexp_count(t, F.lit(":")) == 7)))
    local = t.isin("::1", "::", "::0") | t.rlike("^f[cd]|^fe[89ab]|^ff")
    return F.coalesce((plain & local) | (((tail != "") | (plain & hexed)) & private_v4(dotted)), F.lit(False))


def private_ip(ip: Column) -> Column:
    return private_v4(ip) | private_v6(ip)


def page_request(url: Column, is_document: Column, allowed: Sequence[str]) -> Column:
    """Struct (allow, needs_ip_check, reason) for what a page asks to load: data
    that never touches the network is fine, only web addresses may be fetched,
    and the page itself stays on the allowlist."""
    scheme = F.lower(F.regexp_extract(url, "^([a-zA-Z][a-zA-Z0-9+.-]*):", 1))
    web = scheme.isin("http", "https")
    off = is_document & (url_decision(url, allowed) != "ok")
    inline = scheme.isin("data", "blob", "about")
    reason = (
        F.when(F.coalesce(scheme, F.lit("")) == "", "malformed")
        .when(inline, None)
        .when(~web, F.concat(F.lit("scheme "), scheme))
        .when(host_of(url).isNull(), "malformed")
        .when(off, "off_allowlist")
    )
    return F.struct(reason.isNull().alias("allow"), (reason.isNull() & ~inline).alias("needs_ip_check"), reason.alias("reason"))


def fetch_error_status(code: Column) -> Column:
    """The HTTP status that reports an error of fetching."""
    return F.when(code.isin("malformed_url", "redirect_invalid", "private_ip"), 400).when(code == "oversized", 413).when(code == "timeout", 504).otherwise(502)


def fetch_error_kind(code: Column) -> Column:
    """What went wrong, as a reader may know it."""
    known = code.isin("malformed_url", "redirect_invalid", "private_ip", "dns_failed", "redirect_loop", "too_many_redirects", "timeout", "oversized", "network_error")
    return F.when(code.isin("malformed_url", "redirect_invalid"), "bad_address").when(known, code).otherwise("not_fetched")
