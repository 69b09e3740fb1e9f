"""URL, HTML and date functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import fold, squash

#: Query parameters that only track.
TRACKING = ("fbclid", "gclid", "yclid")


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(F.trim(url), r"#.*$", "")


def canonical(url: Column) -> Column:
    """Without fragment and tracking parameters (utm_*, fbclid, gclid, yclid); other parameters keep their order."""
    plain = without_fragment(url)
    head, query = F.regexp_extract(plain, r"^([^?]*)", 1), F.regexp_extract(plain, r"\?(.*)$", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"^(utm_[^=]*|" + "|".join(TRACKING) + r")(=|$)")), "&")
    return F.when(kept == "", head).otherwise(F.concat(head, F.lit("?"), kept))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


def same_host(url: Column, base: Column) -> Column:
    """Equal hosts, or a relative reference."""
    return (host(url) == "") | (host(url) == host(base))


def pagination(url: Column, last: Column, parameter: str = "page") -> Column:
    """The url once for each page from 1 to last."""
    head = F.regexp_replace(url, rf"([?&]){parameter}=\d*&?", "$1")
    head = F.regexp_replace(head, r"[?&]$", "")
    mark = F.when(F.contains(head, F.lit("?")), F.lit("&")).otherwise(F.lit("?"))
    return F.transform(F.sequence(F.lit(1), last), lambda n: F.concat(head, mark, F.lit(f"{parameter}="), n.cast("string")))


def links(html: Column) -> Column:
    """Targets of anchors, in order."""
    return F.regexp_extract_all(html, F.lit(r'(?i)<a\s[^>]*?href="([^"]*)"'), F.lit(1))


def title(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))


def visible_text(html: Column) -> Column:
    """Text without script, style, comments and tags, five entities decoded, white space squashed."""
    c = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", " ")
    c = F.regexp_replace(c, r"(?s)<[^>]*>", " ")
    for name, plain in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("amp", "&")):
        c = F.replace(c, F.lit(f"&{name};"), F.lit(plain))
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def table_pairs(html: Column) -> Column:
    """Label and value of table rows of two cells, as a map; the first of equal labels stays."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>\s*<t[dh][^>]*>([^<]*)</t[dh]>\s*<td[^>]*>([^<]*)</td>\s*</tr>"), F.lit(0))
    pair = F.transform(rows, lambda r: F.struct(F.trim(F.regexp_extract(r, r"(?is)<t[dh][^>]*>([^<]*)</t[dh]>", 1)).alias("key"), F.trim(F.regexp_extract(r, r"(?is)</t[dh]>\s*<td[^>]*>([^<]*)</td>", 1)).alias("value")))
    first = F.aggregate(pair, F.expr("cast(array() as array<struct<key: string, value: string>>)"), lambda done, p: F.when(F.exists(done, lambda d: d["key"] == p["key"]), done).otherwise(F.concat(done, F.array(p))))
    return F.map_from_entries(first)


def json_ld(html: Column, kind: str) -> Column:
    """The first JSON-LD block of a type, as text."""
    blocks = F.regexp_extract_all(html, F.lit(r'(?is)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'), F.lit(1))
    return F.try_element_at(F.filter(blocks, lambda b: F.lower(F.get_json_object(b, "$.@type")) == kind.lower()), F.lit(1))


def labelled(text: Column, label: str) -> Column:
    """The value after a label, on its line or on the next one."""
    return F.nullif(F.trim(F.regexp_extract(text, rf"(?iu){label}\s*:?[ \t]*\n?[ \t]*([^\n]*)", 1)), F.lit(""))


def date_of(text: Column) -> Column:
    """ISO or day-first dates, whole or within a text; impossible ones are passed over."""
    whole = [F.try_to_date(F.trim(text), f) for f in ("yyyy-M-d", "d/M/yyyy", "d-M-yyyy", "yyyy/M/d")]
    def part(pattern: str, order: tuple[int, int, int]) -> Column:
        y, m, d = (F.regexp_extract(text, pattern, k) for k in order)
        return F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")
    within = [part(r"(?iu)ngày\s+(\d{1,2})\s+tháng\s+(\d{1,2})\s+năm\s+(\d{4})", (3, 2, 1)), part(r"(\d{1,2})[/\-](\d{1,2})[/\-](\d{4})", (3, 2, 1)), part(r"(\d{4})-(\d{2})-(\d{2})", (1, 2, 3))]
    return F.coalesce(*whole, *within)


def sort_date(text: Column) -> Column:
    """Year, month and day as a struct to sort by; zeros where a text is no date."""
    day = F.coalesce(F.try_to_date(F.trim(text), "d/M/yyyy"), F.try_to_date(F.trim(text), "yyyy-M-d"))
    return F.struct(*(F.coalesce(f(day), F.lit(0)).alias(n) for f, n in ((F.year, "y"), (F.month, "m"), (F.dayofmonth, "d"))))


def day_month_year(text: Column) -> Column:
    """The first date of the form dd/mm/yyyy in a text, as it stands there."""
    return F.nullif(F.regexp_extract(text, r"\b\d{1,2}/\d{1,2}/\d{4}\b", 0), F.lit(""))


def effective_from_description(*texts: Column) -> Column:
    """The date after "co hieu luc tu" of the first text that has one (whatever its accents), else the first date of one that speaks of validity."""
    def of(c: Column) -> Column:
        folded = squash(fold(c))
        after = F.nullif(F.regexp_extract(folded, r"co hieu luc tu\s+(\d{1,2}/\d{1,2}/\d{4})", 1), F.lit(""))
        return F.coalesce(after, F.when(F.contains(folded, F.lit("hieu luc")), day_month_year(c)))

    return F.coalesce(*map(of, texts))


#: Phrases of labels that stand where a value is missing.
BOILERPLATE = ("ngày ban hành là ngày", "cho biết trạng thái hiệu lực", "vb liên quan", "đang cập nhật")


def without_boilerplate(c: Column) -> Column:
    """A value; of one that holds a label's phrase, only its date; null where nothing is left."""
    plain = squash(c)
    label = F.exists(F.array(*map(F.lit, BOILERPLATE)), lambda p: F.contains(F.lower(plain), p))
    return F.when(label, day_month_year(plain)).otherwise(F.nullif(plain, F.lit("")))


#: Keys under which dates and status are given, what precedes them in a text, and the status of a text that says nothing.
DATE_KEYS = {
    "issued_date": ("date_issued", "ngay_ban_hanh", "issued_date"), "effective_date": ("effective_date", "ngay_co_hieu_luc", "hieu_luc_tu"), "expiry_date": ("expiry_date", "ngay_het_hieu_luc", "het_hieu_luc", "expiration"),
    "status": ("status", "trang_thai", "tinh_trang", "hieu_luc"),
}
_SHORT, _LONG = r"(\d{1,2})[/-](\d{1,2})[/-](\d{4})", r"(\d{1,2})\s+tháng\s+(\d{1,2})\s+năm\s+(\d{4})"
EFFECTIVE = tuple(rf"(?iu)(?:có\s+hiệu\s+lực|hiệu\s+lực\s+thi\s+hành)\s+từ\s+ngày\s+{x}" for x in (_SHORT, _LONG))
EXPIRES = (rf"(?iu)hết\s+hiệu\s+lực\s+(?:vào\s+)?ngày\s+{_SHORT}", rf"(?iu)ngày\s+{_SHORT}.*?hết\s+hiệu\s+lực")
ENDED, HOLDS = ("hết hiệu lực", "bị thay thế", "đã bị bãi bỏ"), "Vẫn còn hiệu lực"


def legal_dates(values: Column, title: Column, content: Column) -> Column:
    """issued, effective and expiry date and status as a struct: from a map of values, the first key of each that gives one; else from the
    title and the first 5,000 characters. Impossible dates are passed over."""
    def keyed(name: str, parse) -> Column:
        return F.coalesce(*(parse(F.nullif(F.trim(F.try_element_at(values, F.lit(k))), F.lit(""))) for k in DATE_KEYS[name]))

    text = F.trim(F.concat(F.trim(F.coalesce(title, F.lit(""))), F.lit("\n"), F.substring(F.trim(F.coalesce(content, F.lit(""))), 1, 5000)))

    def dated(pattern: str) -> Column:
        d, m, y = (F.regexp_extract(text, pattern, k) for k in (1, 2, 3))
        return F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")

    ended = F.exists(F.array(*map(F.lit, ENDED)), lambda p: F.contains(F.lower(text), p))
    return F.struct(
        keyed("issued_date", date_of).alias("issued_date"), F.coalesce(keyed("effective_date", date_of), *map(dated, EFFECTIVE)).alias("effective_date"), F.coalesce(keyed("expiry_date", date_of), *map(dated, EXPIRES)).alias("expiry_date"),
        F.coalesce(keyed("status", lambda c: c), F.when(ended, "Hết hiệu lực").otherwise(HOLDS)).alias("status"),
    )


#: Texts of anchors that lead to the next page.
NEXT_TEXTS = ("tiếp", "sau", "next", ">", "›", "»")


def next_pages(html: Column, page: Column) -> Column:
    """Absolute targets of anchors whose text leads on, on the page's own host, in order, each once."""
    anchors = F.regexp_extract_all(html, F.lit(r'(?is)<a\s[^>]*?href="[^"]+"[^>]*>.*?</a>'), F.lit(0))
    text = lambda a: F.lower(squash(F.replace(F.replace(F.replace(F.regexp_replace(a, r"(?s)<[^>]*>", " "), F.lit("&gt;"), F.lit(">")), F.lit("&raquo;"), F.lit("»")), F.lit("&rsaquo;"), F.lit("›"))))
    leads = lambda a: text(a).isin(*NEXT_TEXTS) | F.contains(text(a), F.lit("tiếp")) | F.contains(text(a), F.lit("next"))
    root, folder = F.regexp_extract(page, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1), F.regexp_extract(page, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(?:[^?#]*/)?)", 1)
    plain = F.regexp_extract(page, r"^([^?#]*)", 1)

    def absolute(href: Column) -> Column:
        joined = F.when(F.regexp_like(href, F.lit(r"^[A-Za-z][A-Za-z0-9+.\-]*:")), href).when(F.startswith(href, F.lit("//")), F.concat(F.regexp_extract(page, r"^([A-Za-z][A-Za-z0-9+.\-]*:)", 1), href))
        joined = joined.when(F.startswith(href, F.lit("/")), F.concat(root, href)).when(F.startswith(href, F.lit("?")), F.concat(plain, href))
        return without_fragment(joined.otherwise(F.concat(F.when(F.endswith(folder, F.lit("/")), folder).otherwise(F.concat(folder, F.lit("/"))), href)))

    urls = F.transform(F.filter(anchors, leads), lambda a: absolute(F.trim(F.regexp_extract(a, r'(?is)href="([^"]+)"', 1))))
    return F.array_distinct(F.filter(urls, lambda u: host(u) == host(page)))


def year_of(number: Column, *texts: Column) -> Column:
    """The year in a legal number, else in the first text that holds one."""
    return F.coalesce(F.nullif(F.regexp_extract(number, r"/((?:19|20)\d{2})/", 1), F.lit("")), *(F.nullif(F.regexp_extract(t, r"\b((?:19|20)\d{2})\b", 1), F.lit("")) for t in texts)).cast("int")


#: Statuses that hold without an expiry date.
IN_FORCE = ("vẫn còn hiệu lực", "còn hiệu lực", "đang có hiệu lực", "valid", "active")


def valid_on(effective: Column, expiry: Column, status: Column, day: Column) -> Column:
    """In effect on a day: not effective later, not expired by then; without expiry the status decides."""
    begun = F.coalesce(effective <= day, F.lit(True))
    return begun & F.when(expiry.isNotNull(), expiry > day).otherwise(F.coalesce(F.lower(F.trim(status)).isin(*IN_FORCE), F.lit(False)))
