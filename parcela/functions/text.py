"""Scalar text, number and URL functions of listings, as column expressions."""

from __future__ import annotations

import json
import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

@lru_cache(maxsize=1)
def _plain_letters() -> tuple[str, str, dict[str, str]]:
    """Characters beyond ASCII with one plain ASCII form each, those forms, and the characters with longer ones, by compatibility decomposition."""
    plain = {c: unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode() for c in map(chr, range(0x80, sys.maxunicode + 1)) if not 0xD800 <= ord(c) < 0xE000}
    one = {c: p for c, p in plain.items() if len(p) == 1}
    return "".join(one), "".join(one.values()), {c: p for c, p in plain.items() if len(p) > 1}


def slugify(text: Column) -> Column:
    """Lower-case ASCII words joined by hyphens; letters beyond ASCII take their plain form, those without one are dropped."""
    letters, forms, longer = _plain_letters()
    forms_of = F.from_json(F.lit(json.dumps(longer)), "map<string,string>")
    spelled = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.element_at(forms_of, c), c)), "")
    whole = F.when(F.translate(text, "".join(longer), "") != text, spelled).otherwise(text)
    ascii_only = F.regexp_replace(F.translate(whole, letters, forms), r"[^\x00-\x7F]", "")
    return F.regexp_replace(F.regexp_replace(F.lower(ascii_only), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def ar_number(text: Column) -> Column:
    """A number written with points for thousands and a comma for decimals."""
    return F.regexp_extract(F.translate(text, ",.", "."), r"\d+(?:\.\d+)?", 0).try_cast("double")


def external_id(url: Column) -> Column:
    """The id of at least six digits at the end of a listing's address; null without one."""
    return F.nullif(F.regexp_extract(url, r"-(\d{6,})\.html$", 1), F.lit(""))


def is_listing_url(url: Column) -> Column:
    return url.rlike("/propiedades/.*(?:clasificado|emprendimiento)/") & url.rlike(r"-\d{6,}\.html$")


def absolute_url(url: Column, base: str) -> Column:
    """Without query and fragment, with the base before a leading slash; null for anything that is neither."""
    cut = F.regexp_replace(url, "[?#].*$", "")
    return F.when(cut.startswith("/"), F.concat(F.lit(base.rstrip("/")), cut)).when(cut.startswith("http"), cut)


def page_url(url: Column, page: Column) -> Column:
    """The address of a result page; the first page has no number."""
    bare = F.regexp_replace(url, r"-pagina-\d+\.html$", ".html")
    return F.when(page <= 1, url).otherwise(F.concat(F.regexp_replace(bare, r"\.html$", ""), F.lit("-pagina-"), page.cast("string"), F.lit(".html")))


def coordinate(value: Column, most: int) -> Column:
    """A coordinate within ``most`` degrees, undoing a missing decimal point; null if none fits. Rounded to 7 digits."""
    steps = [F.when(F.abs(value / d) <= most, F.round(value / d, 7)) for d in (1, 10_000_000, 1_000_000, 100_000)]
    return F.coalesce(*steps)


def strip_nul(text: Column) -> Column:
    return F.translate(text, "\x00", "")


def dedupe_parts(address: Column) -> Column:
    """An address without its label, link text and repeated or empty parts between commas; either case, with or without accents."""
    bare = F.regexp_replace(F.regexp_replace(address, r"(?iu)^ubicaci[oó]n\s+", ""), r"(?iu)\s*ver informaci[oó]n.*$", "")
    return F.array_join(F.array_distinct(F.filter(F.transform(F.split(bare, ","), lambda p: F.trim(p)), lambda p: p != "")), ", ")


def rooms_text(rooms: Column) -> Column:
    """The bedrooms of a number of rooms, as text: one less, at least one."""
    n = F.greatest(rooms - 1, F.lit(1))
    return F.concat(n.cast("string"), F.when(n > 1, " dormitorios").otherwise(" dormitorio"))
