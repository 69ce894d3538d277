"""URL normal forms and checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track.
TRACKERS = ("gclid", "fbclid", "msclkid", "mc_cid", "mc_eid", "igshid", "_ga")
#: Those of the second form, which also takes https under these suffixes.
NEWS_TRACKERS = ("fbclid", "gclid", "mc_cid", "ref", "os", "hss_meta", "_hsenc", "_hsmi", "_kx")
SECURE_SUFFIXES = (".gov", ".mil")


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(F.trim(url), F.lit("HOST")))


def canonical(url: Column, *, trackers: tuple[str, ...] = TRACKERS, secure_suffixes: tuple[str, ...] = ()) -> Column:
    """B1, B2: scheme and host in lower case, no default port, no slash at the end, no tracking parameters, the others
    sorted, no fragment. Hosts under secure_suffixes take https. A URL that can't be read becomes null."""
    u = F.trim(url)
    part = lambda name: F.try_parse_url(u, F.lit(name))
    scheme, h = F.lower(part("PROTOCOL")), host(url)
    port = F.regexp_extract(part("AUTHORITY"), r":(\d+)$", 1)
    default = ((scheme == "https") & (port == "443")) | ((scheme == "http") & (port == "80"))
    place = F.when((port != "") & ~default, F.concat(h, F.lit(":"), port)).otherwise(h)
    path = F.regexp_replace(F.coalesce(part("PATH"), F.lit("")), "/+$", "")
    pairs = F.filter(
        F.split(F.coalesce(part("QUERY"), F.lit("")), "&"),
        lambda p: (p != "")
        & ~F.lower(p).startswith("utm_")
        & ~F.lower(F.split_part(p, F.lit("="), F.lit(1))).isin(*trackers),
    )
    split = F.transform(pairs, lambda p: F.struct(F.split_part(p, F.lit("="), F.lit(1)).alias("name"), p.alias("pair")))
    query = F.array_join(F.transform(F.array_sort(split), lambda x: x["pair"]), "&")
    secure = F.lit(False)
    for s in secure_suffixes:
        secure = secure | F.endswith(h, F.lit(s))
    return F.concat(
        F.when(secure, "https").otherwise(scheme),
        F.lit("://"),
        place,
        F.when(path == "", "/").otherwise(path),
        F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)),
    )


def within(h: Column, base: Column) -> Column:
    """A host is its base domain or under it; case and a dot at the end don't count."""
    h, base = (F.regexp_replace(F.lower(x), r"\.$", "") for x in (h, base))
    return (h == base) | F.endswith(h, F.concat(F.lit("."), base))


def _octets(address: Column) -> tuple[Column, Column, Column]:
    """The first three numbers of a dotted address; null where there is none."""
    parts = F.split(address, r"\.")
    return tuple(F.get(parts, F.lit(i)).try_cast("int") for i in range(3))


def _private_ipv4(address: Column) -> Column:
    """Whether a dotted address is outside the public ranges, or no address as a number is over 255."""
    a, b, c = _octets(address)
    pair = lambda x, y: (a == x) & (b == y)
    reserved = (pair(192, 88) & (c == 99)) | (pair(198, 51) & (c == 100)) | (pair(203, 0) & (c == 113))
    shared = ((a == 100) & b.between(64, 127)) | ((a == 172) & b.between(16, 31)) | ((a == 198) & b.isin(18, 19))
    local = a.isin(0, 10, 127) | (a >= 224) | pair(169, 254) | pair(192, 168) | pair(192, 0)
    too_large = F.exists(F.split(address, r"\."), lambda x: x.try_cast("int") > 255)
    return local | shared | reserved | too_large


def _private_ipv6(address: Column) -> Column:
    """Whether an address isn't in 2000::/3, or is for documentation or benchmarks, or maps a private IPv4 one."""
    mapped = F.regexp_extract(address, r"^::ffff:(\d+\.\d+\.\d+\.\d+)$", 1)
    first = F.conv(F.split_part(address, F.lit(":"), F.lit(1)), 16, 10).try_cast("int")
    special = address.rlike(r"^2001:(db8|0db8|2|0002)(:|$)")
    return F.when(mapped != "", _private_ipv4(mapped)).otherwise(~F.coalesce(first.between(0x2000, 0x3FFF), F.lit(False)) | special)


def unsafe_reason(url: Column) -> Column:
    """Why a URL isn't a public one, else null."""
    authority = F.try_parse_url(F.trim(url), F.lit("AUTHORITY"))
    place = F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":\d*$", ""))
    six = F.regexp_extract(place, r"^\[([0-9a-f:.]+)\]$", 1)
    h = F.regexp_replace(place, r"\.$", "")
    scheme = F.lower(F.try_parse_url(F.trim(url), F.lit("PROTOCOL")))
    port = F.regexp_extract(authority, r":(\d+)$", 1)
    usual = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    four = h.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    local = h.isin("localhost", "metadata.google.internal", "metadata.goog") | h.rlike(r"\.(local|localhost)$")
    return (
        F.when(F.length(url) > 2048, "length")
        .when(scheme.isNull() | ~scheme.isin("http", "https"), "scheme")
        .when(F.coalesce(h, F.lit("")) == "", "host")
        .when(F.contains(authority, F.lit("@")), "credentials")
        .when(~usual, "port")
        .when(local, "local name")
        .when((six != "") & _private_ipv6(six), "private address")
        .when((six == "") & four & _private_ipv4(h), "private address")
        .when((six == "") & (F.length(h) > 253), "host")
    )


#: The forms of dates in paths, and the places of year, month and day in them. Months and days have two
#: digits in all of them.
PATH_DATES = (
    (r"/(20\d{2})/(0[1-9]|1[0-2])/(0[1-9]|[12]\d|3[01])(?:/|$)", (1, 2, 3)),
    (r"/(20\d{2})-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])(?:[./]|$)", (1, 2, 3)),
    (r"(?i)_(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])(20\d{2})\.[a-z0-9]+$", (3, 1, 2)),
    (r"(?:^|\D)(20\d{2})(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])(?:\D|$)", (1, 2, 3)),
)
#: Fixed value: the form of dates in titles.
TITLE_DATES = ((r"(?:^|\D)(0?[1-9]|1[0-2])[-/ ](0?[1-9]|[12]\d|3[01])[-/ ](20\d{2})(?:\D|$)", (3, 1, 2)),)


def _first_date(text: Column, forms: tuple[tuple[str, tuple[int, int, int]], ...]) -> Column:
    """The first form's date that a text has; the places are those of year, month and day."""
    made = [F.try_to_date(F.concat_ws("-", *[F.regexp_extract(text, form, i) for i in places]), "y-M-d") for form, places in forms]
    return F.coalesce(*made)


def date_in_path(url: Column) -> Column:
    """The date that a URL's path names, else null: /y/m/d, a segment y-m-d, _mmddyyyy before an ending, yyyymmdd."""
    path = F.coalesce(F.try_parse_url(F.trim(url), F.lit("PATH")), F.lit(""))
    return _first_date(path, PATH_DATES)


def date_in_title(title: Column) -> Column:
    """The date m-d-y (or with / or spaces) in a title, else null."""
    return _first_date(title, TITLE_DATES)
