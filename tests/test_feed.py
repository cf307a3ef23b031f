from datetime import date

import pytest
from pyspark.sql import functions as F

from tenderlens.sources import feed

HEAD = ('<?xml version="1.0" encoding="UTF-8"?><feed xmlns="http://www.w3.org/2005/Atom" xmlns:cbc="urn:cbc" '
        'xmlns:cac="urn:cac" xmlns:cac-place-ext="urn:place">')
SIMPLE = """<entry>
  <title>Reparto <![CDATA[de </entry> agua & sal]]></title>
  <summary>Órgano de Contratación: Concello de Lalín; Importe: 8123,40</summary>
  <updated>2022-03-04T07:30:00Z</updated>
  <link href="ftp://x"/><link href="https://data.example.net/q" />
  <cac:ProcurementProject><cbc:TypeCode>2</cbc:TypeCode></cac:ProcurementProject>
  <cac:WinningParty><cbc:Name> </cbc:Name><cbc:Name>NORTE &amp; SUR SA</cbc:Name></cac:WinningParty>
  <cbc:AwardDate>2022-03-05</cbc:AwardDate></entry>"""
GIJON = """<entry><title>Limpieza de playas</title>
  <summary>Órgano de Contratación: Consorcio de Aguas de Gijón; Importe: 2310 EUR</summary>
  <updated>2025-09-30T08:01:02.5+02:00</updated>
  <cac-place-ext:ContractFolderStatus><cac-place-ext:LocatedContractingParty><cac:Party>
    <cac:PostalAddress><cbc:CityName>Gijón</cbc:CityName><cbc:PostalZone>33201</cbc:PostalZone></cac:PostalAddress>
  </cac:Party></cac-place-ext:LocatedContractingParty></cac-place-ext:ContractFolderStatus></entry>"""
FULL = """<entry><!-- a </entry> comment --><title> </title><summary>x</summary><id>http://id/7</id>
  <updated>2025-09-30</updated>
  <cac-place-ext:LocatedContractingParty><cac:Party><cbc:CityName> </cbc:CityName></cac:Party></cac-place-ext:LocatedContractingParty>
  <cac-place-ext:LocatedContractingParty><cac:Party><cac:PostalAddress><cbc:CityName>OLEIROS (A CORUÑA)</cbc:CityName>
  </cac:PostalAddress></cac:Party></cac-place-ext:LocatedContractingParty>
  <cac:ContractingParty><cbc:Name> Universidad Abierta </cbc:Name></cac:ContractingParty>
  <cbc:ContractTypeCode>WORKS</cbc:ContractTypeCode>
  <cbc:TaxExclusiveAmount>0</cbc:TaxExclusiveAmount><cbc:TaxExclusiveAmount>741.25</cbc:TaxExclusiveAmount>
  <cbc:AwardDate>1905-07-07</cbc:AwardDate><cbc:AwardDate>0021-02-03</cbc:AwardDate>
  <cbc:ItemClassificationCode>n/a</cbc:ItemClassificationCode><cbc:ItemClassificationCode>33100000</cbc:ItemClassificationCode></entry>"""
SITE = """<entry><summary>Órgano Contratante: Ayuntamiento de Monforte; Importe: 10</summary>
  <cac:RealizedLocation><cac:Address><cbc:CountrySubentity>lugo</cbc:CountrySubentity></cac:Address></cac:RealizedLocation></entry>"""
PREFIXED = ("<atom:entry><atom:title>p</atom:title><atom:summary>Órgano Contratante: Universidad de León; Importe: 5"
            "</atom:summary></atom:entry>")
BROKEN = "<entry><title>broken</entry>"
TOO_MUCH = "<entry><summary>Órgano Contratante: X; Importe: 50.000,01</summary></entry>"
NO_BUYER = "<entry><summary>Importe: 5</summary></entry>"
NO_AMOUNT = "<entry><summary>Órgano Contratante: X</summary></entry>"


def page(*entries, tail="</feed>", head=""):
    return HEAD + head + "\n".join(entries) + tail


def pages(spark, *texts):
    return spark.createDataFrame([(f"https://h/f/p{i}.atom", t) for i, t in enumerate(texts, 1)], "source_file string, value string")


def read(spark, *entries, **kw):
    rows = feed.feed_contracts(feed.feed_entries(pages(spark, page(*entries, **kw))), max_year=2027, keep=["entry_ord"])
    return {r.entry_ord: r for r in rows.collect()}


def test_entry_fields(spark):
    r = read(spark, SIMPLE)[0]
    assert (r.buyer, r.buyer_type, r.municipality, r.amount) == ("Concello de Lalín", "Ayuntamiento", "Lalín", 8123.4)
    assert (r.contract_type, r.supplier, r.supplier_key) == ("Servicios", "NORTE & SUR SA", "NORTE & SUR SA")
    assert (r.subject, r.award_date, r.fiscal_year) == ("Reparto de </entry> agua & sal", date(2022, 3, 5), 2022)
    assert (r.file_url, r.cpv) == ("https://data.example.net/q", None)


def test_places_and_fallbacks(spark):
    rows = read(spark, GIJON, FULL, SITE)
    v, f, s = rows[0], rows[1], rows[2]
    assert (v.municipality, v.province, v.region) == ("Gijón", "Asturias", "Asturias")
    assert (v.supplier, v.supplier_key, v.award_date) == ("No consta", None, date(2025, 9, 30))
    assert (f.municipality, f.province, f.region) == ("Oleiros", "A Coruña", "Galicia")
    assert (f.buyer, f.amount, f.contract_type, f.cpv) == ("Universidad Abierta", 741.25, "Obras", "33100000")
    assert (f.award_date, f.subject, f.file_url) == (date(2021, 2, 3), "Sin concepto", "http://id/7")
    assert (s.municipality, s.province, s.region, s.contract_type) == ("Monforte", "Lugo", "Galicia", "Otros")
    assert (s.award_date, s.fiscal_year) == (None, None)


def test_bad_entries_are_left_out_and_the_rest_survives(spark):
    rows = read(spark, SIMPLE, BROKEN, TOO_MUCH, NO_BUYER, NO_AMOUNT, PREFIXED, GIJON, tail="<entry><title>cut")
    assert sorted(rows) == [0, 5, 6]
    assert (rows[5].buyer, rows[5].province) == ("Universidad de León", "León")
    rejects = feed.feed_rejects(feed.feed_entries(pages(spark, page(SIMPLE, BROKEN)))).collect()
    assert [(r.entry_ord, r.entry_xml, r.reason) for r in rejects] == [(1, BROKEN, "malformed")]
    rejects = feed.feed_rejects(feed.feed_entries(pages(spark, page(SIMPLE, TOO_MUCH, NO_BUYER, NO_AMOUNT)))).collect()
    assert {r.entry_ord: r.reason for r in rejects} == {1: "over limit", 2: "no buyer", 3: "no amount"}
    entries = feed.feed_entries(pages(spark, page(TOO_MUCH, NO_AMOUNT)))
    assert [r.amount for r in feed.feed_contracts(entries, limit=None).collect()] == [50_000.01]
    assert [r.reason for r in feed.feed_rejects(entries, limit=None).collect()] == ["no amount"]


def test_comments_sections_and_instructions_in_order(spark):
    entry = "<entry>{}<summary>Órgano Contratante: {}; Importe: 3</summary></entry>"
    rows = read(spark, entry.format("<!-- see <![CDATA[ -->", "A"), entry.format("", "B"), entry.format("<!-- <?x -->", "C"),
                entry.format("<?pi <!-- ?>", "D"), entry.format("<title><![CDATA[<!-- kept --> <?kept?>]]></title>", "E"))
    assert [r.buyer for _, r in sorted(rows.items())] == ["A", "B", "C", "D", "E"]
    assert rows[4].subject == "<!-- kept --> <?kept?>"


def test_a_quoted_end_of_tag_is_no_end(spark):
    entry = """<entry note="a>b"><summary>Órgano Contratante: X; Importe: 3</summary>
      <cac:WinningParty kind='>"'><cbc:Name note="a>b" other='"'>OK SL</cbc:Name></cac:WinningParty></entry>"""
    assert read(spark, entry)[0].supplier == "OK SL"


def test_only_a_direct_party_gives_a_place(spark):
    entry = """<entry><summary>Órgano Contratante: X; Importe: 3</summary>
      <cac:LocatedContractingParty><cac:AgentParty><cac:Party><cbc:CityName>Lugo</cbc:CityName></cac:Party></cac:AgentParty>
        <cac:Party><cbc:CityName>Gijón</cbc:CityName></cac:Party></cac:LocatedContractingParty></entry>"""
    assert read(spark, entry)[0].municipality == "Gijón"


def test_the_amount_limit_is_inclusive(spark):
    entry = TOO_MUCH.replace("50.000,01", "50.000,00")
    assert read(spark, entry)[0].amount == 50_000.0


def test_attributes_references_and_nesting(spark):
    entry = """<entry><summary>Órgano Contratante: X; Importe: 7</summary>
      <cac:ProcurementProject><cac:Sub><cbc:TypeCode>3</cbc:TypeCode></cac:Sub><cbc:TypeCode/><cbc:TypeCode listURI="u"> 1
      </cbc:TypeCode></cac:ProcurementProject>
      <cac:WinningParty><cac:PartyName><cbc:Name/><cbc:Name lang="es">A &lt;&#243;&gt; &amp; B</cbc:Name></cac:PartyName></cac:WinningParty>
      <cac:WinningParty><cbc:Name>Second</cbc:Name></cac:WinningParty><cbc:Nameless>n</cbc:Nameless>
      <cbc:ItemClassificationCode listURI="u">4500</cbc:ItemClassificationCode>
      <cac:LocatedContractingParty><cac:Other><cbc:CityName>Lugo</cbc:CityName></cac:Other></cac:LocatedContractingParty>
      <cac:LocatedContractingParty><cac:Party><cac:AgentParty><cac:Party></cac:Party></cac:AgentParty>
        <cbc:CityName>vigo</cbc:CityName></cac:Party></cac:LocatedContractingParty>
      </entry>"""
    r = read(spark, entry)[0]
    assert (r.contract_type, r.supplier, r.cpv, r.municipality) == ("Suministros", "A <ó> & B", "4500", "Vigo")


def test_empty_pages(spark):
    assert feed.feed_entries(pages(spark, page(), "", "no xml")).count() == 0


def test_page_chain(spark):
    def link(href, rel="next"):
        return f'<link rel="{rel}" href="{href}"/>'

    chain = feed.feed_page_chain(pages(
        spark, page(SIMPLE, head=link("p9.atom", "self") + link("p2.atom")), page(GIJON, head=link("https://h/f/p4.atom?x=1")),
        page(SIMPLE), page("<broken", head=link("p1.atom")), page(head=link("/g/p1.atom")), page(head=link("./p7.atom")),
    ))  # another folder's p1.atom is another page
    got = {r.page: (r.next_url, r.next_is_present) for r in chain.collect()}
    assert got == {
        "p1.atom": ("https://h/f/p2.atom", True), "p2.atom": ("https://h/f/p4.atom?x=1", True), "p3.atom": (None, None),
        "p4.atom": (None, None), "p5.atom": ("https://h/g/p1.atom", False), "p6.atom": ("https://h/f/p7.atom", False),
    }


def test_reading_parses_an_entry_once(spark):
    rows = feed.feed_contracts(feed.feed_entries(pages(spark, page(SIMPLE)))).where("amount > 5 AND supplier_key IS NOT NULL")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_xml(StructField(title") == 1 and plan.count("<WinningParty") == 1


def test_rejects_are_told_in_one_pass(spark):
    broken = "<entry><summary>Importe: 3</summary><x>&nothing;</x></entry>"
    rejects = feed.feed_rejects(feed.feed_entries(pages(spark, page(SIMPLE, broken, NO_BUYER))))
    plan = rejects._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_xml(StructField(title") == 1 and "Union" not in plan
    assert [(r.entry_ord, r.reason) for r in rejects.orderBy("entry_ord").collect()] == [(1, "malformed"), (2, "no buyer")]


def test_white_space_of_every_kind_is_cut_off_without_a_pattern(apply, spark):
    spaces = "".join(map(chr, [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
    assert apply(feed._blank_to_null, [f"{spaces}a{spaces}b{spaces}", spaces, "", "\u180ec\u200b", None]) == [f"a{spaces}b", None, None, "\u180ec\u200b", None]
    plan = feed.feed_contracts(feed.feed_entries(pages(spark, page(SIMPLE))))._jdf.queryExecution().optimizedPlan().toString()
    assert r"^\s+|\s+$" not in plan


@pytest.mark.parametrize("name", ["a.atom", "b.xml"])
def test_read_files(spark, tmp_path, name):
    (tmp_path / name).write_text(page(SIMPLE, GIJON), encoding="utf-8")
    (tmp_path / "notes.txt").write_text(page(SIMPLE), encoding="utf-8")
    rows = feed.feed_entries(feed.read_feed_pages(spark, str(tmp_path))).select(F.substring_index("source_file", "/", -1).alias("f"))
    assert [r.f for r in rows.collect()] == [name] * 2


def test_pages_without_anything_to_escape_take_one_pass_and_give_the_same(apply):
    texts = [
        "a<!-- x -->b<?y z?>c<![CDATA[plain ]] text]]>d", "<![CDATA[a & b]]><!-- <![CDATA[ -->e", "<![CDATA[<!-- no comment -->]]>f",
        "<!<!-- x -->[CDATA[made]]>g", "<!-- open <![CDATA[shut]]>h", "<![CDATA[a]]><![CDATA[b > c]]><!--d-->", "<![CDATA[open", "<??>i<!---->", "plain",
    ]
    assert apply(feed._plain_xml, texts) == [
        "abcplain ]] textd", "a &amp; be", "&lt;!-- no comment --&gt;f", "<![CDATA[made]]>g", "<!-- open shuth", "ab &gt; c", "<![CDATA[open",
        "i", "plain",
    ]


def test_special_parts_begin_with_one_fixed_character():
    # The matcher passes over plain text at the speed of a search for that character.
    assert all(p.startswith("(?s)<(?:") for p in (feed.SPECIAL, feed.SPECIAL_CONTENT))


def test_each_field_of_an_address_is_sought_once(spark):
    """Where a field is named several times, the text it is found in is searched once, and a type code in plain sight is not parsed."""
    rows = feed.feed_contracts(feed.feed_entries(pages(spark, page(SIMPLE))), max_year=2027)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert [plan.count(f"<{name}(?") for name in ("CityName", "PostalZone", "CountrySubentity")] == [1, 1, 1]


def test_type_codes_in_plain_sight_and_others(spark):
    entry = "<entry><summary>Órgano Contratante: X; Importe: 7</summary><cac:ProcurementProject a='>'>{}</cac:ProcurementProject>{}</entry>"
    second = "<cac:ProcurementProject><cbc:TypeCode>1</cbc:TypeCode></cac:ProcurementProject>"
    cases = [
        ("<cbc:TypeCode>3</cbc:TypeCode>", "Obras"), ("<cbc:Name>n</cbc:Name> <cbc:TypeCode listURI='u>'> 3 </cbc:TypeCode>", "Obras"),
        ("<cbc:TypeCodes>8</cbc:TypeCodes><cbc:TypeCode>&#51;</cbc:TypeCode>", "Obras"), ("<cbc:TypeCode> </cbc:TypeCode>", "Suministros"),
        ("<cac:Sub><cbc:TypeCode>8</cbc:TypeCode></cac:Sub><cbc:TypeCode>3</cbc:TypeCode>", "Obras"), ("<cbc:TypeCode/>", "Suministros"),
        ("<cbc:TypeCode/><cbc:TypeCode>3</cbc:TypeCode>", "Obras"), ("<cbc:Name/><cbc:TypeCode>2</cbc:TypeCode>", "Servicios"),
        ("<cbc:TypeCode>99</cbc:TypeCode>", "Tipo 99"),
    ]
    found = read(spark, *[entry.format(text, after) for after in (second, "") for text, _ in cases])
    alone = [{"Suministros": "Otros"}.get(label, label) for _, label in cases]
    assert [found[i].contract_type for i in range(2 * len(cases))] == [label for _, label in cases] + alone
