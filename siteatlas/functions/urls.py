"""URL columns: one grammar, resolving, normalised and canonical forms, hosts that anybody may reach, guide paths, identifiers, scope and reading priority.

All of it is built from Spark's own functions, so that it also works on the
elements of an array. Only hosts with characters beyond ASCII need an Arrow
function, `punycoded`, before the URL is normalised.
"""

import re
from collections.abc import Callable
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from siteatlas.functions.arrow import arrow

_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
_REFERENCE = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"
_PLACE = r"^(\[[^\[\]]*\]|[^:\[\]]*)(?::([0-9]*))?$"
# Words that rank a page's last segment, and any segment.
USEFUL = "pricing plans about products services docs help support get-started getting-started quickstart shipping returns fair-use-policy integrations api plans-and-pricing features".split()
LOW_VALUE = "login signup sign-up cart checkout search tag tags".split()
ELIGIBLE = "docs help support blog learn products developers".split()
IGNORED = "(utm_.*|gclid|fbclid)"
MOST_CHARACTERS, MOST_FIELDS = 2048, 50
# Blocks that the registries of special-purpose addresses keep from public use, and the public parts of them.
CLOSED_4 = "0.0.0.0/8 10.0.0.0/8 100.64.0.0/10 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/24 192.0.2.0/24 192.168.0.0/16 198.18.0.0/15 198.51.100.0/24 203.0.113.0/24 224.0.0.0/3".split()
OPEN_4 = "192.0.0.9/32 192.0.0.10/32".split()
GLOBAL_6 = "2000::/3"
CLOSED_6 = "2001::/23 2001:db8::/32 2002::/16 3fff::/20".split()
OPEN_6 = "2001:1::1/128 2001:1::2/128 2001:3::/32 2001:4:112::/48 2001:20::/28 2001:30::/28".split()


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where the value is computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def part(url: Column, i: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query with ?, 5 fragment with #."""
    return F.regexp_extract(url, _PARTS, i)


def canonical(url: Column) -> Column:
    """Lower-case scheme and authority, / for no path; query and fragment stay."""
    path = F.when(part(url, 3) == "", F.lit("/")).otherwise(part(url, 3))
    return F.concat(F.lower(part(url, 1)), F.lit("://"), F.lower(part(url, 2)), path, part(url, 4), part(url, 5))


def dotless(path: Column) -> Column:
    """Path without empty, . and .. segments; a trailing slash stays."""
    none = F.array().cast("array<string>")
    up = lambda a: F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))
    kept = F.aggregate(F.split(path, "/"), none, lambda a, x: F.when((x == "") | (x == "."), a).when(x == "..", up(a)).otherwise(F.concat(a, F.array(x))))
    return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(path.endswith("/") & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit("")))


def _number(quad: Column) -> Column:
    """An IPv4 address as a number, NULL for anything else."""
    ok = quad.rlike(r"^(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}$")
    return F.when(ok, F.aggregate(F.split(quad, r"\."), F.lit(0).cast("long"), lambda n, x: n * 256 + x.cast("long")))


def _in_4(number: Column, blocks: list[str]) -> Column:
    out = F.lit(False)
    for block in blocks:
        first, bits = block.split("/")
        value = 0
        for x in first.split("."):
            value = 256 * value + int(x)
        out = out | (F.shiftright(number, 32 - int(bits)) == value >> (32 - int(bits)))
    return out


def _groups(address: Column) -> Column:
    """An IPv6 address as eight numbers, NULL for anything else."""
    quad = F.regexp_extract(address, r":([0-9]+\.[0-9.]+)$", 1)
    as_groups = lambda n: F.concat(F.regexp_replace(address, r"[0-9.]+$", ""), F.hex(F.shiftright(n, 16)), F.lit(":"), F.hex(n.bitwiseAND(65535)))
    plain = F.when(quad == "", address).otherwise(let(_number(quad), as_groups))
    listed = lambda text: F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ":"))

    def filled(halves: Column) -> Column:
        left, right = listed(halves[0]), listed(F.coalesce(F.get(halves, F.lit(1)), F.lit("")))
        n = F.size(left) + F.size(right)
        ok = F.when(F.size(halves) == 2, n < 8).otherwise((F.size(halves) == 1) & (n == 8))
        every = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(8 - n, F.lit(0))), right)
        return F.when(ok & F.forall(every, lambda x: x.rlike("^[0-9A-Fa-f]{1,4}$")), F.transform(every, lambda x: F.conv(x, 16, 10).cast("int")))

    return let(F.split(plain, "::"), filled)


def _in_6(groups: Column, blocks: list[str]) -> Column:
    out = F.lit(False)
    for block in blocks:
        first, bits = block.split("/")
        left, _, right = first.partition("::")
        left, right, left_bits = left.split(":"), right.split(":") if right else [], int(bits)
        values, same = [int(x, 16) for x in [*left, *["0"] * (8 - len(left) - len(right)), *right]], F.lit(True)
        for i, value in enumerate(values):
            took = min(16, left_bits - 16 * i)
            if took > 0:
                same = same & (F.shiftright(groups[i], 16 - took) == value >> (16 - took))
        out = out | same
    return out


def public(host: Column) -> Column:
    """Whether an address (not a name) is one that anybody may reach."""
    open_4 = lambda n: F.coalesce(~_in_4(n, CLOSED_4) | _in_4(n, OPEN_4), F.lit(False))
    open_6 = lambda g: F.coalesce(_in_6(g, [GLOBAL_6]) & (~_in_6(g, CLOSED_6) | _in_6(g, OPEN_6)), F.lit(False))
    return F.when(host.isNotNull(), F.when(F.contains(host, F.lit(":")), let(_groups(host), open_6)).otherwise(let(_number(host), open_4)))


def _reachable(scheme: Column, place: Column) -> Column:
    """The host of a URL's authority, lower case and without its default port; NULL for another port, a private address or a name without a public domain."""
    port = F.regexp_replace(F.regexp_extract(place, _PLACE, 2), "^0+(?=.)", "")
    usual = (port == "") | (port == F.when(scheme == "https", "443").otherwise("80"))
    domain = r"^[^.\x00-\x20\x7f-\x{10ffff}]{1,63}(\.[^.\x00-\x20\x7f-\x{10ffff}]{1,63})+$"

    def kept(host: Column) -> Column:
        inner = F.regexp_extract(host, r"^\[(.*)\]$", 1)
        named = host.rlike(domain) & ~host.rlike(r"%|\.(localhost|local|internal)$")
        return F.when(F.startswith(host, F.lit("[")), F.when(public(inner), host)).when(_number(host).isNotNull(), F.when(public(host), host)).when(named, host)

    return F.when(place.rlike(_PLACE) & usual, let(F.regexp_replace(F.lower(F.regexp_extract(place, _PLACE, 1)), r"\.+$", ""), kept))


def decoded(text: Column) -> Column:
    """Without percent codes; broken codes stay."""
    return F.url_decode(F.regexp_replace(F.replace(text, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25"))


def _field(text: Column, to: str) -> Column:
    """A query's name or value, decoded or encoded as forms are."""
    if to == "plain":
        return F.url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"))
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _fields(query: Column) -> Column:
    """A query with its ?, its named values sorted, without blank and tracking ones."""
    pairs = F.filter(F.split(F.substring(query, 2, MOST_CHARACTERS), "&"), lambda x: x.rlike("^[^=]*=."))
    cut = lambda x: F.struct(_field(F.regexp_extract(x, "^([^=]*)=", 1), "plain").alias("k"), _field(F.regexp_extract(x, "^[^=]*=(.*)$", 1), "plain").alias("v"))
    own = F.array_sort(F.filter(F.transform(pairs, cut), lambda x: ~F.lower(x["k"]).rlike(f"^{IGNORED}$")))
    text = F.array_join(F.transform(own, lambda x: F.concat(_field(x["k"], "code"), F.lit("="), _field(x["v"], "code"))), "&")
    return let(text, lambda t: F.when(t == "", t).otherwise(F.concat(F.lit("?"), t)))


def normalized(url: Column) -> Column:
    """One form for each public resource: default ports, tracking and blank parameters and fragments go, parameters are sorted, dot segments are followed. NULL where unsafe."""
    parts = F.struct(F.lower(part(url, 1)).alias("scheme"), part(url, 2).alias("place"), part(url, 3).alias("path"), part(url, 4).alias("query"), ((F.length(url) <= MOST_CHARACTERS) & ~url.rlike(r"[\x00-\x20\\]")).alias("plain"))
    safe = lambda u: u["plain"] & u["scheme"].isin("http", "https") & ~F.contains(u["place"], F.lit("@")) & (F.length(F.regexp_replace(u["query"], "[^&]", "")) < MOST_FIELDS)
    double = lambda path: F.when(path.rlike("^//(?!/)"), "/").otherwise("")
    form = lambda u, host: F.concat(u["scheme"], F.lit("://"), host, double(u["path"]), dotless(u["path"]), _fields(u["query"]))
    return let(parts, lambda u: F.when(safe(u), let(_reachable(u["scheme"], u["place"]), lambda host: F.when(host.isNotNull(), form(u, host)))))


def _followed(path: Column) -> Column:
    """Path without . and .. segments; empty ones stay."""
    none = F.array().cast("array<string>")
    segments = F.split(path, "/")
    up = lambda a: F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(1)))
    kept = F.aggregate(segments, none, lambda a, x: F.when(x == ".", a).when(x == "..", up(a)).otherwise(F.concat(a, F.array(x))))
    last = F.when(F.element_at(segments, -1).isin(".", ".."), "/").otherwise("")
    return F.concat(F.array_join(kept, "/"), last)


def resolved(base: Column, href: Column) -> Column:
    """A reference as seen from a page."""
    own = lambda i: F.regexp_extract(F.trim(F.coalesce(href, F.lit(""))), _REFERENCE, i)
    base = F.coalesce(base, F.lit(""))
    parts = F.struct(*(own(i).alias(n) for i, n in enumerate(("scheme", "place", "path", "query", "tail"), 1)), F.trim(F.coalesce(href, F.lit(""))).rlike("^([A-Za-z][A-Za-z0-9+.-]*:)?//").alias("placed"))
    root = F.concat(part(base, 1), F.lit("://"), part(base, 2))
    folder = F.regexp_replace(F.when(part(base, 3) == "", "/").otherwise(part(base, 3)), "[^/]*$", "")

    def joined(u: Column) -> Column:
        tail = F.concat(u["query"], u["tail"])
        path = F.when(F.startswith(u["path"], F.lit("/")), u["path"]).otherwise(F.concat(folder, u["path"]))
        near = F.when(u["path"] == "", F.concat(root, part(base, 3), F.when(u["query"] == "", part(base, 4)).otherwise(u["query"]), u["tail"])).otherwise(F.concat(root, _followed(path), tail))
        placed = F.concat(F.when(u["scheme"] == "", part(base, 1)).otherwise(u["scheme"]), F.lit("://"), u["place"], _followed(u["path"]), tail)
        return F.when(u["placed"], placed).when(u["scheme"] != "", F.concat(u["scheme"], F.lit(":"), u["path"], tail)).otherwise(near)

    return let(parts, joined)


def destination(url: Column) -> Column:
    """A link target that may be written into a guide, other characters than a URL's as percent codes; NULL where it isn't safe."""
    safe = url.rlike(r"^(?i:https?)://[^/?#@:][^/?#@]*([/?#]|$)") & ~url.rlike(r"[\x00-\x1f\x7f]")
    codes = lambda c: F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")
    plain = r"^[A-Za-z0-9:/?#\[\]@!$&'()*+,;=%~._-]*$"
    quoted = F.array_join(F.transform(F.regexp_extract_all(url, F.lit("(?s)."), F.lit(0)), lambda c: F.when(c.rlike(plain), c).otherwise(codes(c))), "")
    return F.when(safe, F.when(url.rlike(plain), url).otherwise(quoted))


def guide_scope(path: Column) -> Column:
    """/a/b/ for a site path; NULL where it isn't one or could lead elsewhere."""
    refused = path.rlike(r"^(?!/)|^//|[?#\\]|%2[fF]")
    elsewhere = lambda plain: plain.rlike(r"//|\\|[\x00-\x20]|(^|/)\.\.?(/|$)")
    return F.when(~refused & ~let(decoded(path), elsewhere), let(F.trim(path, F.lit("/")), lambda inner: F.when(inner == "", "/").otherwise(F.concat(F.lit("/"), inner, F.lit("/")))))


_WIDE = re.compile(r"^([A-Za-z][A-Za-z0-9+.-]*://)([^/?#:\[\]@]*[^\x00-\x7f][^/?#:\[\]@]*)(.*)$", re.DOTALL)


def ascii_host(url: str | None) -> str | None:
    """The URL with an international host as ASCII; as it is where that has none."""
    if url is None or url.isascii() or not (m := _WIDE.match(url)):
        return url
    try:
        return m[1] + m[2].encode("idna").decode() + m[3]
    except UnicodeError:
        return url


@arrow("string")
def punycoded(url: pd.Series) -> pd.Series:
    return pd.Series([ascii_host(x) for x in url], dtype=object)


def joined(base: str | None, href: str | None) -> str | None:
    """resolved() for one row, as the standard library does it; None where that can't read the reference."""
    try:
        return urljoin(base or "", (href or "").strip())
    except ValueError:
        return None


def source_id(url: Column) -> Column:
    return F.concat(F.lit("src_"), F.substring(F.sha2(url, 256), 1, 20))


def section(url: Column) -> Column:
    """First path segment, (entry) for none."""
    return F.coalesce(F.nullif(F.regexp_extract(part(url, 3), "^/+([^/]+)", 1), F.lit("")), F.lit("(entry)"))


def rank(url: Column) -> Column:
    """3 with a low-value segment, 0 for a useful last one, else 1."""
    parts = F.filter(F.split(F.lower(part(url, 3)), "/"), lambda x: x != "")
    return F.when(F.arrays_overlap(parts, F.array(*map(F.lit, LOW_VALUE))), 3).when(F.try_element_at(parts, F.lit(-1)).isin(USEFUL), 0).otherwise(1)


def depth(url: Column) -> Column:
    """Path segments, one for none."""
    return F.greatest(F.size(F.filter(F.split(part(url, 3), "/"), lambda x: x != "")), F.lit(1))
