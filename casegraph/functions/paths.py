"""The host that a collected file comes from, told by its path."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .exprs import let
from .lookups import HOST_PATTERN, HOST_START, IN_HOSTS, NO_HOST_PARTS, NO_HOST_WORDS, NO_HOSTS

ADDRESS = r"^\d{1,3}(?:\.\d{1,3}){3}$"


def host_like(name: Column, marks: tuple[str, ...] = ()) -> Column:
    """Whether a folder may be named after a host. marks: what tools add to the names of folders they unpack into."""
    p = F.lower(name)
    letters = F.regexp_replace(p, r"[^\p{L}]", "")
    none = p.isin(NO_HOSTS) | p.rlike("|".join(NO_HOST_PARTS)) | p.rlike(r"^[0-9a-f]{6,}$")
    for m in marks:
        none = none | F.contains(p, F.lit(m))
    none = none | ((F.char_length(p) >= 8) & (F.char_length(letters) >= 4) & ~p.rlike("[aeiou]"))
    mixed = F.char_length(p).between(2, 20) & p.rlike(r"\p{L}") & p.rlike(r"\p{N}") & p.rlike(r"(?U)^[\w-]+$")
    return ~none & (p.rlike(HOST_PATTERN) | (mixed & (p.rlike("[aeiou]") | p.rlike(HOST_START))))


def clean_host(name: Column) -> Column:
    """Lower case, anything but letters, digits and addresses as single hyphens; 'unknown-host' for nothing."""
    p = F.lower(F.trim(name))
    words = F.regexp_replace(F.regexp_replace(p, r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.when(p.rlike(ADDRESS), p).when(F.coalesce(words, F.lit("")) == "", "unknown-host").otherwise(words)


def host_of_path(path: Column, root: Column, marks: tuple[str, ...] = (), given: Column | None = None) -> Column:
    """The host of a file by its path below root, by the first rule that finds one.

    1. a host-like folder right before one that stands in a host's; 2. the first host-like part; 3. the first word of three characters, not
    a number, an address or a version of a system, in the parts before any folder that is no host; 4. the first part with an address in it, also with hyphens;
    5. the first folder, unless it is none; 6. the root's name. given goes before all.
    """
    low = lambda p: F.lower(p)
    like = lambda p: F.coalesce(host_like(p, marks), F.lit(False))
    first = lambda found: F.get(found, 0)
    stop = sorted({*NO_HOSTS, *IN_HOSTS})
    bad = [*NO_HOST_WORDS, *marks]

    def word(w: Column) -> Column:
        return ~w.isin(bad) & ~w.rlike(r"^\p{N}+$") & ~w.rlike(ADDRESS) & ~w.rlike(r"^win.*\p{N}") & (F.char_length(w) >= 3) & w.rlike(r"\p{L}")

    def address(p: Column) -> Column:
        ip = F.regexp_replace(F.regexp_extract(p, r"(\d{1,3}[.-]\d{1,3}[.-]\d{1,3}[.-]\d{1,3})", 1), "-", ".")
        return F.when((ip != "") & F.forall(F.split(ip, r"\."), lambda o: o.try_cast("int") <= 255), ip)

    def found(parts: Column) -> Column:
        before = first(F.filter(parts, lambda p, k: F.coalesce(low(F.get(parts, k + 1)).isin(IN_HOSTS), F.lit(False)) & like(p)))
        heads = F.filter(parts, lambda p, k: ~F.exists(F.slice(parts, 1, k + 1), lambda q: low(q).isin(stop)))
        words = F.filter(F.flatten(F.transform(heads, lambda p: F.split(F.translate(low(p), "_", "-"), "-"))), word)
        folder = F.when((F.size(parts) >= 2) & ~low(F.get(parts, 0)).isin(NO_HOSTS), F.get(parts, 0))
        return F.coalesce(before, first(F.filter(parts, like)), first(words), first(F.filter(F.transform(parts, address), lambda a: a.isNotNull())), folder)

    parts = F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda p: p != "")
    return clean_host(F.coalesce(*([given] if given is not None else []), let(parts, found), root))
