"""Atom feeds of minor contracts.

A page (one file, about 4 MB) is one row; its entries are cut out and read with XML expressions, so a folder of
any number of pages is read by as many tasks as there are splits. Elements are found by local name, at any
depth and under any prefix. The XML reader sees each entry once, to tell whether it is well formed and to read its
direct children; deeper elements are then cut out of the sound text, which costs a fraction of a parse per field.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tenderlens.functions import (
    contract_type_label,
    extract_summary,
    infer_buyer_type,
    infer_geography,
    infer_municipality,
    let,
    normalize_award_date,
    normalize_municipality,
    normalize_province,
    parse_money,
    province_from_postcode,
    province_in_text,
    region_from_province,
)
from tenderlens.functions.text import not_empty
from tenderlens.refdata import LIMIT_INGEST, NO_SUBJECT, NO_SUPPLIER, WORKS_CODES

FEED_FILES = "*.{atom,xml}"
# Comments, CDATA sections and processing instructions, whichever begins first: none is looked for inside another.
# It begins with one fixed character, which the matcher looks for much faster than for three alternatives.
SPECIAL = r"(?s)<(?:!--.*?-->|!\[CDATA\[.*?\]\]>|\?.*?\?>)"
# The same with the content of a section as $1 if nothing in it is to be escaped, else the whole section.
SPECIAL_CONTENT = r"(?s)<(?:!--.*?-->|!\[CDATA\[([^&<>]*?)\]\]>|\?.*?\?>)|(<!\[CDATA\[.*?\]\]>)"
# What may stand in a start tag: a > only between quotes.
ATTRIBUTES = r"(?:\s(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)?(?<!/)>"
ENTRY = rf"(?s)<(?:[\w.-]++:)?+entry{ATTRIBUTES}(?:[^<]++|<(?!/(?:[\w.-]++:)?+entry\s*+>))*+</(?:[\w.-]++:)?+entry\s*+>"
ALL_ENTRIES = rf"(?s)<(?:[\w.-]++:)?+entry{ATTRIBUTES}.*</(?:[\w.-]++:)?+entry\s*+>"
# White space as in Unicode.
SPACE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

# Direct children of an entry; the reader also tells whether the entry is well formed.
ENTRY_HEAD = (
    "title array<string>, summary array<string>, updated array<string>, id array<string>, "
    "link array<struct<_href: string>>, _corrupt_record string"
)
FEED_HEAD = "link array<struct<_rel: string, _href: string>>, _corrupt_record string"
XML_OPTIONS = {"mode": "PERMISSIVE", "ignoreNamespace": "true"}


def read_feed_pages(spark: SparkSession, folder: str | list[str], pattern: str = FEED_FILES) -> DataFrame:
    """One row per feed file: its path and its whole text."""
    return (
        spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True)
        .select(F.col("_metadata.file_path").alias("source_file"), "value")
    )


def _plain_xml(page: Column) -> Column:
    """The page with CDATA sections as escaped text, without comments and instructions, so that tags are only tags."""
    def escape(c: Column) -> Column:
        for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            c = F.replace(c, F.lit(char), F.lit(entity))
        return c

    def content(special: Column) -> Column:
        inside = F.substring(special, F.lit(10), F.length(special) - 12)
        return F.when(special.startswith("<![CDATA["), escape(inside)).otherwise("")

    def unwrap(text: Column) -> Column:
        contents = F.transform(F.regexp_extract_all(text, F.lit(SPECIAL), F.lit(0)), content)
        return F.array_join(
            F.zip_with(F.split(text, SPECIAL, -1), contents, lambda t, c: F.concat(t, F.coalesce(c, F.lit("")))), ""
        )

    # One pass does for a page whose sections hold nothing to escape. A section that is left sends it the long way.
    def plain(text: Column) -> Column:
        return F.when(text.contains("<![CDATA["), unwrap(page)).otherwise(text)

    quick = let(F.regexp_replace(page, SPECIAL_CONTENT, "$1$2"), plain)
    return F.when(page.contains("<!") | page.contains("<?"), quick).otherwise(page)


def feed_entries(pages: DataFrame) -> DataFrame:
    """One row per entry. A cut-off last entry is left out; entries after a damaged one are kept."""
    plain = pages.select("source_file", _plain_xml(F.col("value")).alias("page"))
    found = F.regexp_extract_all("page", F.lit(ENTRY), F.lit(0))
    return plain.select("source_file", F.posexplode(found).alias("entry_ord", "entry_xml"))


PREFIX = r"(</?+)[\w.-]++:"
PLACE = "struct<municipality: string, province: string, region: string>"
PLACE_FIELDS = ("CityName", "CountrySubentity", "PostalZone")
CPV_CODE = r"^\d{4,}$"
PLAIN_TYPE_CODE = (
    rf"(?s)^<ProcurementProject{ATTRIBUTES}(?:\s*+<(?!TypeCode[\s/>])([\w.-]++){ATTRIBUTES}[^<]*+</\1\s*+>)*+\s*+"
    rf"<TypeCode{ATTRIBUTES}([^<&\r]++)</TypeCode\s*+>"
)


def _blank_to_null(c: Column) -> Column:
    return not_empty(F.btrim(c, F.lit(SPACE)))


def _elements(xml: Column, name: str) -> Column:
    """All elements of a name at any depth, as XML. Comments and CDATA are gone, so a tag is a tag."""
    return F.regexp_extract_all(xml, F.lit(rf"(?s)<{name}{ATTRIBUTES}.*?</{name}\s*>"), F.lit(0))


def _texts(xml: Column, name: str) -> Column:
    """Texts of all leaf elements of a name at any depth, without those of white space alone."""
    raw = F.regexp_extract_all(xml, F.lit(rf"<{name}{ATTRIBUTES}([^<]*)</{name}\s*>"), F.lit(1))

    def plain(text: Column) -> Column:
        # Character references are rare; the XML reader knows them all.
        spelled = F.xpath_string(F.concat(F.lit("<t>"), text, F.lit("</t>")), F.lit("/t"))
        return _blank_to_null(F.when(text.contains("&"), spelled).otherwise(text))

    return F.filter(F.transform(raw, plain), lambda t: t.isNotNull())


def _inside(xml: Column, parent: str) -> Column:
    """The elements of a name as one text, to look for others in them."""
    return F.array_join(_elements(xml, parent), "")


def _first(values: Column) -> Column:
    return F.get(values, F.lit(0))


def place_struct(city: Column, subentity: Column, postcode: Column) -> Column:
    """Municipality, province and region from the parts of one address."""
    def build(p: Column) -> Column:
        province = F.coalesce(
            normalize_province(p["subentity"]),
            province_from_postcode(p["postcode"]),
            province_in_text(p["city"]),
            province_in_text(p["municipality"]),
        )
        return let(province, lambda name: F.struct(
            p["municipality"].alias("municipality"), name.alias("province"), region_from_province(name).alias("region")
        ))

    # The parts are found in a text each time they are named, so they are bound before the municipality is made of one.
    parts = F.struct(city.alias("city"), subentity.alias("subentity"), postcode.alias("postcode"))
    return let(parts, lambda p: let(F.struct(
        p["city"].alias("city"), p["subentity"].alias("subentity"), p["postcode"].alias("postcode"),
        normalize_municipality(p["city"]).alias("municipality"),
    ), build))


def _usable(place: Column) -> Column:
    known = F.coalesce(place["municipality"], place["province"], place["region"])
    return F.when(known.isNotNull(), place)


def contract_territory(xml: Column) -> Column:
    """Address of the contracting party first, then the place where the contract is carried out.

    The first element that gives any place counts; the elements after it are not read.
    """
    def read(address: Column) -> Column:
        return let(place_struct(*[_first(_texts(address, field)) for field in PLACE_FIELDS]), _usable)

    # Of a contracting party only a party directly below it counts: the XML reader gives its content as text.
    parties = F.flatten(F.transform(
        F.filter(_elements(xml, "LocatedContractingParty"), lambda x: x.contains("<Party")),
        lambda x: F.coalesce(F.from_xml(x, "Party array<string>")["Party"], F.array().cast("array<string>")),
    ))
    addresses = F.concat(F.filter(parties, lambda x: x.isNotNull()), _elements(xml, "RealizedLocation"))
    return F.aggregate(addresses, F.lit(None).cast(PLACE), lambda found, address: F.coalesce(found, read(address)))


def _first_valid(values: Column, read: Callable[[Column], Column]) -> Column:
    return F.get(F.filter(F.transform(values, read), lambda v: v.isNotNull()), F.lit(0))


def _type_code(projects: Column) -> Column:
    """The first type code that is a direct child of a project."""
    # The XML reader sees just the direct children. Of one project, where elements without others in them stand before the code,
    # it is plain to see; a project in which another begins, or a code with anything to spell out, is left to the reader.
    first = _first(projects)
    plain = F.when((F.size(projects) == 1) & ~F.substring(first, 2, 1 << 30).contains("<ProcurementProject"), not_empty(F.btrim(F.regexp_extract(first, PLAIN_TYPE_CODE, 2), F.lit(SPACE))))
    read = F.flatten(F.transform(projects, lambda x: F.from_xml(x, "TypeCode array<string>")["TypeCode"]))
    return F.coalesce(plain, _first(F.filter(F.transform(read, _blank_to_null), lambda c: c.isNotNull())))


def _parsed(xml: Column, head: Column, min_year: int, max_year: int | None) -> Column:
    """Fields of a well-formed entry as one struct."""
    def date(c: Column) -> Column:
        return normalize_award_date(c, min_year, max_year)

    works = F.exists(_texts(xml, "ContractTypeCode"), lambda c: c.isin(*WORKS_CODES))
    http = F.filter(head["link"], lambda x: x["_href"].startswith("http"))
    return F.struct(
        _first(_texts(_inside(xml, "WinningParty"), "Name")).alias("supplier"),
        _first(F.filter(_texts(xml, "ItemClassificationCode"), lambda c: c.rlike(CPV_CODE))).alias("cpv"),
        _first(http)["_href"].alias("link"),
        contract_type_label(let(_elements(xml, "ProcurementProject"), _type_code), works).alias("contract_type"),
        _first_valid(_texts(xml, "AwardDate"), date).alias("award_date"),
        contract_territory(xml).alias("place"),
    )


def split_well_formed(entries: DataFrame) -> DataFrame:
    """Entries with their direct children and whether the XML is well formed."""
    head = F.from_xml("entry_xml", ENTRY_HEAD, XML_OPTIONS)
    # A one-element explode keeps the parse in one place: later filters cannot repeat it.
    return entries.select("*", F.explode(F.array(head)).alias("head")).withColumn(
        "well_formed", F.col("head").isNotNull() & F.col("head._corrupt_record").isNull()
    )


def _with_buyer_and_amount(entries: DataFrame, carried: list[str], sound: str = "entry_xml") -> DataFrame:
    """Entries of ``split_well_formed`` with what decides whether they are contracts, read from the column ``sound``."""
    def head(name: str) -> Column:
        return _blank_to_null(F.get(f"head.{name}", F.lit(0)))

    xml = F.regexp_replace(sound, PREFIX, "$1")
    good = entries.select(*carried, "head", F.explode(F.array(xml)).alias("xml")).select(
        *carried, "xml", "head", head("title").alias("title"), head("updated").alias("updated"), head("id").alias("id"),
        extract_summary(head("summary")).alias("summary"),
    )
    # Buyer and amount usually stand in the summary; the entry itself is only searched where they do not.
    buyer = F.coalesce("summary.buyer", _first(_texts(_inside(F.col("xml"), "ContractingParty"), "Name")))
    amount = F.coalesce("summary.amount", _first_valid(_texts(F.col("xml"), "TaxExclusiveAmount"), parse_money))
    # One-element explodes keep each parse in one place: later filters and columns cannot repeat it.
    return good.select("*", F.inline(F.array(F.struct(buyer.alias("buyer"), amount.alias("amount")))))


def feed_rejects(entries: DataFrame, limit: float | None = LIMIT_INGEST) -> DataFrame:
    """Entries that do not become contracts, with the first reason that holds."""
    # One pass for both kinds: two would make the entries twice. Nothing is looked for in a malformed entry.
    parsed = split_well_formed(entries).withColumn("sound", F.when(F.col("well_formed"), F.col("entry_xml")))
    carried = ["source_file", "entry_ord", "entry_xml"]
    over = F.lit(False) if limit is None else F.col("amount") > limit
    reason = (
        F.when(~F.col("well_formed"), "malformed").when(F.col("buyer").isNull(), "no buyer")
        .when(F.col("amount").isNull(), "no amount").when(over, "over limit")
    )
    judged = _with_buyer_and_amount(parsed, [*carried, "well_formed"], "sound").select(*carried, reason.alias("reason"))
    return judged.where(F.col("reason").isNotNull())


def feed_contracts(
    entries: DataFrame,
    min_year: int = 2010,
    max_year: int | None = None,
    keep: Iterable[str] = (),
    limit: float | None = LIMIT_INGEST,
    revisions: bool = False,
) -> DataFrame:
    """Contracts of well-formed entries. Entries without buyer or amount are left out, and those above ``limit``.

    A contract above the limit is no minor one; ``None`` takes all. ``feed_rejects`` lists what is left out.
    ``keep`` names columns of the entries, such as the file they come from, to carry along. With ``revisions`` each has
    its entry's id and time of change too, as ``upsert_revisions`` needs them.
    """
    carried = list(keep)
    known = _with_buyer_and_amount(split_well_formed(entries).where("well_formed"), carried).where(
        F.col("buyer").isNotNull() & (F.col("amount").isNotNull() if limit is None else F.col("amount") <= limit)
    )

    inferred = F.struct(
        infer_geography(F.col("buyer")).alias("place"), infer_municipality(F.col("buyer")).alias("municipality")
    )
    parsed = known.select(
        "*", F.inline(F.array(F.struct(_parsed(F.col("xml"), F.col("head"), min_year, max_year).alias("p"), inferred.alias("inferred"))))
    )
    award = F.coalesce("p.award_date", normalize_award_date(F.col("updated"), min_year, max_year))
    http_id = F.when(F.col("id").startswith("http"), F.col("id"))
    return parsed.select(
        *carried,
        "buyer",
        infer_buyer_type(F.col("buyer")).alias("buyer_type"),
        F.coalesce("p.place.province", "inferred.place.province").alias("province"),
        F.coalesce("p.place.region", "inferred.place.region").alias("region"),
        F.coalesce("p.place.municipality", "inferred.municipality").alias("municipality"),
        F.col("p.contract_type").alias("contract_type"),
        F.coalesce("title", F.lit(NO_SUBJECT)).alias("subject"),
        F.col("p.cpv").alias("cpv"),
        F.coalesce("p.supplier", F.lit(NO_SUPPLIER)).alias("supplier"),
        F.col("p.supplier").alias("supplier_key"),
        award.alias("award_date"),
        F.year(award).alias("fiscal_year"),
        "amount",
        F.coalesce("p.link", http_id).alias("file_url"),
        *([F.col("id").alias("entry_id"), F.col("updated").try_cast("timestamp").alias("updated")] if revisions else []),
    )


def _resolve(base: Column, href: Column) -> Column:
    """A link against the address of its page."""
    root = F.regexp_extract(base, r"^([a-zA-Z][\w+.-]*://[^/]*)", 1)
    folder = F.regexp_replace(base, r"[^/]*$", "")
    joined = (
        F.when(href.rlike(r"^[a-zA-Z][\w+.-]*:"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, r"^([a-zA-Z][\w+.-]*:)", 1), href))
        .when(href.startswith("/"), F.concat(root, href))
        .otherwise(F.concat(folder, href))
    )
    return F.regexp_replace(joined, r"(?<!:/)/(?:\./)+", "/")


def _address(c: Column) -> Column:
    return F.regexp_replace(c, r"[?#].*$", "")


def page_links(pages: DataFrame, base_url: Column | None = None) -> DataFrame:
    """source_file, own_address, next_url and address (without query and fragment) of the next page that each page names.

    Links are resolved against ``base_url``, the file path by default.
    """
    frame = F.from_xml(F.regexp_replace(_plain_xml(F.col("value")), ALL_ENTRIES, ""), FEED_HEAD, XML_OPTIONS)
    next_link = F.get(F.filter("head.link", lambda x: (x["_rel"] == "next") & (x["_href"] != "")), F.lit(0))["_href"]
    base = F.col("source_file") if base_url is None else base_url
    return (
        pages.select("source_file", base.alias("base"), F.explode(F.array(frame)).alias("head"))
        .select("source_file", _address(F.col("base")).alias("own_address"), _resolve(F.col("base"), next_link).alias("next_url"))
        .withColumn("address", _address(F.col("next_url")))
    )


def feed_page_chain(pages: DataFrame, base_url: Column | None = None) -> DataFrame:
    """Next page that each page names, and whether that page is there.

    Links are resolved against ``base_url``, the file path by default, and pages are matched by their whole address, so
    equal file names in two folders are two pages.
    """
    def file_name(c: Column) -> Column:
        return F.substring_index(_address(c), "/", -1)

    base = F.col("source_file") if base_url is None else base_url
    links = page_links(pages, base_url)
    present = pages.select(_address(base).alias("address")).distinct().withColumn("is_present", F.lit(True))
    found = F.when(F.col("next_url").isNotNull(), F.coalesce("is_present", F.lit(False)))
    return links.join(present, "address", "left").select(
        file_name(F.col("source_file")).alias("page"), "next_url", file_name(F.col("next_url")).alias("next_page"),
        found.alias("next_is_present"),
    )


def missing_pages(pages: DataFrame, base_url: Column | None = None) -> DataFrame:
    """Pages that another page names as next and that are not there."""
    chain = feed_page_chain(pages, base_url)
    return chain.where(~F.col("next_is_present")).select("page", "next_url", "next_page")


