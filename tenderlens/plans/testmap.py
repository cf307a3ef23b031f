"""The audit tables, read from the star-schema test tables.

Nation and region have a fixed number of rows, so they are broadcast, and so are the names made of them; the other joins are
left to Spark's own size estimates and adaptive execution. Where a table is too large to be broadcast it is hashed, by parts,
so that the lines it meets need not be sorted; a sort would hold all lines of a partition in memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tenderlens.functions import infer_buyer_type, region_from_province
from tenderlens.functions.text import lookup
from tenderlens.refdata import INE_PROVINCES, NO_SUPPLIER
from tenderlens.sources.parts import stored_bytes

YEARS_SHIFT = 28 * 12  # months from the test dates to plausible award dates
HASHED_BYTES = 16 << 20  # of a table's files; larger ones are hashed in joins
TASK_BYTES = 4 << 20  # of a table's files; so much is dealt to one task where its rows are made into text
SEGMENTS = ("BUILDING", "AUTOMOBILE", "MACHINERY", "HOUSEHOLD")


SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def dealt(spark: SparkSession, sf_dir: str, name: str, least: int) -> int:
    """Number of tasks that grows with a table's files."""
    return max(least, -(-stored_bytes(spark, f"{sf_dir}/{name}.parquet") // TASK_BYTES))


def money(c: Column) -> Column:
    """A tenth of the price, cut to the cent in whole numbers so that any engine gets the same double."""
    return F.floor(F.round(c * 100) / 10).cast("bigint") / 100.0


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _awards(spark, sf_dir).select(
        "buyer", "buyer_type", "province", "region", "municipality", "contract_type", "subject", "cpv", "supplier",
        "supplier_key", "award_date", "fiscal_year", "amount", "file_url",
    )


def keyed_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts with the order line they come from."""
    return _awards(spark, sf_dir)


def _awards(spark: SparkSession, sf_dir: str) -> DataFrame:
    def read(name: str) -> DataFrame:
        return table(spark, sf_dir, name)

    def keyed(name: str, rows: DataFrame) -> DataFrame:
        return rows.hint("shuffle_hash") if stored_bytes(spark, f"{sf_dir}/{name}.parquet") > HASHED_BYTES else rows

    nation_code = F.lpad((F.col("n_nationkey") + 1).cast("string"), 2, "0")
    places = (
        read("nation").join(F.broadcast(read("region")), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("n_nationkey", nation_code.alias("nation_code"))
        .withColumn("province", lookup(F.col("nation_code"), INE_PROVINCES))
        .withColumn("region", region_from_province(F.col("province")))
    )
    # What a buyer is called follows from its nation, segment and town, so names are made once for each of these and meet the
    # lines last: up to there they would go through every shuffle of the lines.
    def who(nation: Column, segment: Column, odd: Column) -> Column:
        """Nation, segment and the sign and oddness of the number (-1, 0, 1) in one number."""
        place = F.coalesce(F.array_position(F.array(*map(F.lit, SEGMENTS)), segment), F.lit(0))
        return nation.cast("bigint") * 15 + place * 3 + odd + 1

    town = F.concat(F.lit("Villa "), F.col("odd").cast("string"))
    segment = F.col("segment")
    buyer = (
        F.when(segment == "BUILDING", F.concat(F.lit("Ayuntamiento de "), town, F.lit(" ("), "province", F.lit(")")))
        .when(segment == "AUTOMOBILE", F.concat(F.lit("Diputación Provincial de "), "province"))
        .when(segment == "MACHINERY", F.concat(F.lit("Universidad de "), "province"))
        .when(segment == "HOUSEHOLD", F.concat(F.lit("Hospital de "), "province"))
        .otherwise(F.concat(F.lit("Gobierno de "), "region"))
    )
    buyers = (
        places.select("*", F.explode(F.array(*[F.lit(name) for name in (*SEGMENTS, "")])).alias("segment"))
        .select("*", F.explode(F.array(*[F.lit(n).cast("bigint") for n in (-1, 0, 1)])).alias("odd"))
        .select(who(F.col("n_nationkey"), segment, F.col("odd")).alias("named_as"), "nation_code", "province", "region",
                buyer.alias("buyer"), F.when(segment == "BUILDING", town).alias("municipality"))
        .withColumn("buyer_type", infer_buyer_type(F.col("buyer")))
    )
    customers = read("customer").select(
        "c_custkey", who(F.col("c_nationkey"), F.col("c_mktsegment"), F.col("c_custkey") % 2).alias("buyer_key"))
    # Orders are fewer than lines, so customers join them first.
    orders = (
        read("orders").select("o_orderkey", "o_custkey")
        .join(keyed("customer", customers), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "buyer_key")
    )
    kind = (
        F.when(F.col("p_type") == "ECONOMY", "Obras").when(F.col("p_type") == "PROMO", "Concesión de obras")
        .when(F.col("p_type") == "SMALL", "Suministros").otherwise("Servicios")
    )
    has_supplier = F.col("l_orderkey") % 17 != 0
    date = F.when(F.col("l_orderkey") % 29 != 0, F.add_months(F.col("l_shipdate").cast("date"), YEARS_SHIFT))
    return (
        read("lineitem")
        .join(keyed("orders", orders), F.col("l_orderkey") == F.col("o_orderkey"))
        # Suppliers are few, so their names come after the shuffle for the parts.
        .join(keyed("part", read("part").select("p_partkey", "p_name", "p_type", "p_size")), F.col("l_partkey") == F.col("p_partkey"))
        .join(keyed("supplier", read("supplier").select("s_suppkey", "s_name")), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(F.broadcast(buyers), F.col("buyer_key") == F.col("named_as"))
        .select(
            "l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey", "nation_code", "buyer", "buyer_type",
            "province", "region",
            "municipality",
            F.when(F.col("l_orderkey") % 31 != 0, kind).alias("contract_type"),
            F.concat(F.lit("Suministro de "), "p_name").alias("subject"),
            F.when(F.col("p_size") % 3 != 0, F.concat(F.lpad(F.col("p_size").cast("string"), 2, "0"), F.lit("000000")))
            .alias("cpv"),
            F.when(has_supplier, F.col("s_name")).otherwise(NO_SUPPLIER).alias("supplier"),
            F.when(has_supplier, F.col("s_name")).alias("supplier_key"),
            date.alias("award_date"),
            F.year(date).alias("fiscal_year"),
            money(F.col("l_extendedprice")).alias("amount"),
            F.concat(F.lit("https://contratos.example.org/"), F.col("l_orderkey").cast("string"), F.lit("-"),
                     F.col("l_linenumber").cast("string")).alias("file_url"),
        )
    )


def budget_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.lpad((F.col("c_nationkey") + 1).cast("string"), 2, "0")
    number = (F.col("c_custkey") % 500).cast("string")
    # Some names hold what a CSV file has to quote.
    quoted = F.concat(F.lit(' Entidad "'), number, F.lit('", zona\ndos '))
    name = F.when(F.col("c_custkey") % 500 % 7 == 0, quoted).otherwise(F.concat(F.lit(" Entidad "), number, F.lit("  ")))
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("idente"),
        name.alias("nombreente"),
        F.concat(code, F.lit("078")).alias("codbdgel"),
    )


def budget_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")

    def text(c: Column) -> Column:
        return (c.cast("decimal(18,0)") / 100).cast("decimal(18,2)").cast("string")

    return lines.select(
        F.col("o_custkey").cast("string").alias("idente"),
        F.when(F.col("l_returnflag") == "R", "I").otherwise("G").alias("tipreig"),
        F.concat(F.lit(" "), F.col("l_linenumber").cast("string"), (F.col("l_partkey") % 100).cast("string"))
        .alias("cdcta"),
        F.when(F.col("l_orderkey") % 23 == 0, "n/d").otherwise(text(cents)).alias("importer"),
        text(cents + 1000).alias("imported"),
        text(F.floor(cents / 2).cast("bigint")).alias("importel"),
    )


def text_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as they are, plus one page per order line that states ids, phones, dates and amounts.

    The test tables are single row groups, which no reader can split, so their rows are dealt out here.
    """
    least = 2 * spark.sparkContext.defaultParallelism
    documents = table(spark, sf_dir, "documents").repartition(dealt(spark, sf_dir, "documents", least)).select("doc_id", F.lit(1).alias("page"), "text")
    key = F.col("l_orderkey")
    digits = F.lpad((key * 7919 % 100_000_000).cast("string"), 8, "0")
    price = F.floor(F.col("l_extendedprice")).cast("bigint")
    thousands = F.concat((F.floor(price / 1000)).cast("string"), F.lit("."),
                         F.lpad((price % 1000).cast("string"), 3, "0"))
    day = F.date_format("l_shipdate", "dd/MM/yyyy")
    text = F.concat(
        F.lit("Factura "), key.cast("string"), F.lit("\nNIF "), digits,
        F.when(key % 2 == 0, "-").otherwise(""), F.lit("Z fecha "), day, F.lit(" importe "), thousands,
        F.when(key % 3 == 0, " €").when(key % 3 == 1, " EUR").otherwise("euros"),
        F.lit("\ntel. 6"), F.substring(digits, 1, 2), F.lit(" "), F.substring(digits, 3, 3), F.lit(" "),
        F.substring(digits, 6, 3), F.lit(" cuenta ES12 3456 "), F.substring(digits, 1, 4), F.lit(" "),
        F.substring(digits, 5, 4), F.lit(" 0001 22, correo linea"), F.col("l_linenumber").cast("string"),
        F.lit("@ejemplo.es; IVA incluido 18.000 € y 14.500 EUR."),
    )
    lines = table(spark, sf_dir, "lineitem").repartition(dealt(spark, sf_dir, "lineitem", least)).select(
        (key + 1_000_000_000).alias("doc_id"), F.col("l_linenumber").alias("page"), text.alias("text")
    )
    return documents.unionByName(lines)


FEED_ORDERS_PER_PAGE = 250
TYPE_CODES = {"Obras": "3", "Concesión de obras": "22", "Suministros": "1", "Servicios": "2"}


def feed_amount() -> Column:
    """Amount in the feed: every seventh line states the full price, which may exceed the limit."""
    return F.when(F.col("l_linenumber") == 7, F.col("l_extendedprice")).otherwise(F.col("amount"))


def _xml(c: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def _tag(name: str, value: Column) -> Column:
    """An element, left out if the value is null."""
    return F.coalesce(F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>")), F.lit(""))


def feed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed pages written from the contracts, with the variety of real entries.

    A page holds a few lines of a fixed number of orders, so no page grows with the data.
    """
    key = F.col("l_orderkey")
    buyer, amount = _xml(F.col("buyer")), F.format_number(feed_amount(), 2)
    in_summary = F.concat(
        F.when((key % 7 != 0) & (key % 101 != 0), F.concat(F.lit("Órgano de Contratación: "), buyer, F.lit("; ")))
        .otherwise(""),
        F.when(key % 5 != 0, F.concat(F.lit("Importe: "), F.translate(amount, ",.", ".,"), F.lit(" EUR"))).otherwise(""),
    )
    party = F.when((key % 7 == 0) & (key % 101 != 0), _tag("cac:PartyName", _tag("cbc:Name", buyer)))
    city = F.when(F.col("municipality").isNotNull(),
                  F.concat(F.upper("municipality"), F.lit(" ("), F.upper("province"), F.lit(")")))
    postcode = F.when(city.isNull() & (key % 3 == 0), F.concat("nation_code", F.lit("001")))
    place = F.when(city.isNotNull() | postcode.isNotNull(), F.concat(_tag("cbc:CityName", city),
                                                                    _tag("cbc:PostalZone", postcode)))
    subentity = F.when(city.isNotNull() & (key % 5 == 1), F.upper("province"))
    place = F.concat(place, _tag("cbc:CountrySubentity", subentity))
    elsewhere = F.lit("<cbc:CityName>SEVILLA</cbc:CityName><cbc:PostalZone>41001</cbc:PostalZone>")
    # A party deeper down does not count, nor does any place after the first that can be used.
    deeper = F.when(key % 3 == 0, _tag("cac:AgentParty", _tag("cac:Party", elsewhere))).otherwise("")
    party_place = F.concat(deeper, _tag("cac:Party", place))
    located = F.when(key % 2 == 0, _tag("cac-place-ext:LocatedContractingParty", F.when(place.isNotNull(), party_place)))
    unusable = F.lit("<cac-place-ext:LocatedContractingParty><cac:Party><cbc:CityName> </cbc:CityName></cac:Party>"
                     "</cac-place-ext:LocatedContractingParty>")
    located = F.coalesce(located, F.when((key % 2 == 1) & (key % 3 == 1), unusable))
    realized = F.when((key % 2 == 1) | (place.isNotNull() & (key % 3 == 1)), _tag("cac:RealizedLocation", _tag(
        "cac:Address", F.when(key % 2 == 1, place).otherwise(elsewhere))))
    date = F.col("award_date").cast("string")
    written = F.when(key % 13 == 0, F.concat(F.lit("00"), F.substring(date, 3, 8))).otherwise(date)
    has_link = key % 11 != 0
    entry = F.concat(
        F.lit("<entry>"),
        F.when(key % 4 == 0, "<!-- see <![CDATA[ --><?note a > b?>").otherwise(""),
        F.concat(F.lit("<title><![CDATA["), "subject", F.lit("]]></title>")),
        _tag("id", F.when(~has_link, F.col("file_url")).otherwise("urn:x")),
        _tag("summary", in_summary),
        _tag("updated", F.lit("1999-01-01T00:00:00Z")),
        F.when(has_link, F.concat(F.lit('<link href="'), "file_url", F.lit('"/>'))).otherwise(""),
        _tag("cac:ContractingParty", party), F.coalesce(located, F.lit("")),
        F.lit("<cac:ProcurementProject>"), _tag("cbc:TypeCode", lookup(F.col("contract_type"), TYPE_CODES)),
        _tag("cbc:ItemClassificationCode", F.col("cpv")), F.coalesce(realized, F.lit("")),
        F.lit("</cac:ProcurementProject>"),
        _tag("cac:WinningParty", F.concat(F.lit("<cbc:Name> </cbc:Name>"), F.coalesce(
            F.concat(F.lit('<cbc:Name note="a > b" kind=\'"\'>'), _xml(F.col("supplier_key")), F.lit("</cbc:Name>")), F.lit("")))),
        F.when(F.col("supplier_key").isNotNull() & (key % 9 == 0),
               "<cac:WinningParty><cbc:Name>Otro SL</cbc:Name></cac:WinningParty>").otherwise(""),
        F.when(key % 5 == 0, _tag("cbc:TaxExclusiveAmount", F.replace(amount, F.lit(","), F.lit("")))).otherwise(""),
        _tag("cbc:AwardDate", written),
        F.lit("</entry>"),
    )
    # An order with very many lines goes over several pages, numbered apart from the others.
    page = F.floor(key / FEED_ORDERS_PER_PAGE).cast("bigint") + F.floor(F.col("l_linenumber") / 8).cast("bigint") * 10**9
    head = F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<feed xmlns="http://www.w3.org/2005/Atom" xmlns:cbc="urn:cbc" '
              'xmlns:cac="urn:cac" xmlns:cac-place-ext="urn:place"><title>Contratos</title><link rel="next" '
              'href="page-'), (F.col("page") + 1).cast("string"), F.lit('.atom"/>\n'),
    )
    # A given number of partitions is not merged by adaptive execution: reading the pages is heavy work. It grows with the lines,
    # so a task holds no more text on larger tables. Entries are written after the shuffle, which their text need not go through.
    tasks = dealt(spark, sf_dir, "lineitem", max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return (
        _awards(spark, sf_dir).withColumn("page", page)
        .repartition(tasks, "page").select("page", entry.alias("entry")).groupBy("page").agg(F.array_join(F.collect_list("entry"), "\n").alias("entries"))
        .select(
            F.concat(F.lit("https://feeds.example.org/minor/page-"), F.col("page").cast("string"), F.lit(".atom"))
            .alias("source_file"),
            F.concat(head, "entries", F.lit("\n<entry><title>cut</entry>\n</feed>")).alias("value"),
        )
    )


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON manifest per hundred web pages."""
    run = F.floor(F.col("page_id") / 100).cast("bigint")
    urls = F.array_sort(F.collect_list(F.struct("page_id", "url")))
    return (
        table(spark, sf_dir, "pages").groupBy(run.alias("run")).agg(urls.alias("u"))
        .select(F.to_json(F.struct(
            F.concat(F.lit("2024-01-01T00:00:00Z#"), F.col("run").cast("string")).alias("fecha_utc"),
            F.lit("contratos menores").alias("fuente"),
            F.col("u.url").alias("urls_visitadas"),
            F.element_at("u.url", -1).alias("ultimo_url"),
            F.array().cast("array<string>").alias("errores"),
        )).alias("value"))
    )
