"""Texts and structured-data documents per carrier, for the whole directory."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haulbook.functions import cleaning as c
from haulbook.operators.directory import state_table, with_state_name
from haulbook.operators.ranking import fleet_rank, slug_pages
from haulbook.schemas import PAGE_SIZE, STATE_NAMES

DEFAULT_SITE = "https://directory.example"
STATE_PAGE = 25
STATE_ITEMS = 10
SMALL_FLEET = 10
POOR_RATE = 2
OFFERS_SHOWN = 2

# Offer categories in order of preference, per kind of carrier.
OFFERS_TROUBLED = ("compliance", "insurance", "eld", "factoring")
OFFERS_SMALL = ("factoring", "insurance", "eld", "compliance")
OFFERS_OTHER = ("insurance", "eld", "compliance", "factoring")

STATIC_PAGES = ("", "/search", "/api-access", "/blog", "/terms", "/privacy", "/refunds")
URLSET_HEAD = (
    '<?xml version="1.0" encoding="UTF-8"?>'
    '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'
)
INDEX_HEAD = (
    '<?xml version="1.0" encoding="UTF-8"?>'
    '<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'
)


# The wording of the texts.
ANSWER = "USDOT {dot} is the FMCSA registration number for {name}{place}.{fleet}{record}"
ANSWER_PLACE = ", a motor carrier based in {city}, {state}"
ANSWER_FLEET = " The company operates {vehicles} vehicles{crew}"
ANSWER_CREW = " with {drivers} drivers."
ANSWER_RECORD = (
    " It has {inspections} roadside inspections and {violations} violations on record in the"
    " last 24 months."
)
FAQ_WHAT = "What is USDOT {dot}?"
FAQ_HOW_MANY = "How many violations does {name} have?"
FAQ_VIOLATIONS = (
    "{name} has {violations} recorded violations in the last 24 months across {inspections}"
    " roadside inspections, according to public FMCSA data."
)
FAQ_ALLOWED = "Is {name} authorized to operate?"
FAQ_STATUS = "{name}'s registration status is {status} according to FMCSA records."
FAQ_NO_STATUS = (
    "{name} is registered with the FMCSA under USDOT {dot}. Check the FMCSA SAFER system for"
    " current operating authority."
)
PAGE_TITLE = "{name} (USDOT {dot}) | Safety Record"
PAGE_DESCRIPTION = "View safety data, inspections and violations for {name}. USDOT {dot}{based}."
PAGE_BASED = ", based in {state}"
COVERAGE_ALL = "Interstate (operates across state lines)"
COVERAGE_HOME = "{home} only ({kind})"
COVERAGE_UNKNOWN_HOME = "Home state"
STATE_LIST_NAME = "Trucking companies in {state}"


def _fill(wording: str, **values: Column) -> Column:
    """The wording with its placeholders replaced by columns; null if one of them is."""
    parts = []
    for literal, field, _, _ in Formatter().parse(wording):
        parts += [F.lit(literal)] if literal else []
        parts += [values[field]] if field else []
    return F.concat(*parts)


def _or_nothing(condition: Column, text: Column) -> Column:
    return F.when(condition, text).otherwise(F.lit(""))


def document_base(counted: DataFrame) -> DataFrame:
    """What the documents are made of: carriers with totals (`safety.with_totals`), display
    name and state name."""
    base = counted.withColumns(
        {
            "inspections_total": F.coalesce("inspections_total", F.lit(0)),
            "violations_total": F.coalesce("violations_total", F.lit(0)),
            "name": c.display_name(),
        }
    )
    return with_state_name(base)


def answer_sentence() -> Column:
    vehicles, drivers = F.col("total_vehicles"), F.col("total_drivers")
    place = _or_nothing(
        F.col("city").isNotNull() & F.col("state").isNotNull(),
        _fill(ANSWER_PLACE, city=F.col("city"), state=F.col("state")),
    )
    crew = F.when(
        F.coalesce(drivers, F.lit(0)) != 0, _fill(ANSWER_CREW, drivers=c.thousands(drivers))
    ).otherwise(F.lit("."))
    fleet = _or_nothing(
        F.coalesce(vehicles, F.lit(0)) != 0,
        _fill(ANSWER_FLEET, vehicles=c.thousands(vehicles), crew=crew),
    )
    record = _or_nothing(
        F.col("inspections_total") > 0,
        _fill(
            ANSWER_RECORD,
            inspections=c.thousands("inspections_total"),
            violations=c.thousands("violations_total"),
        ),
    )
    return _fill(
        ANSWER, dot=F.col("usdot_number"), name=F.col("name"), place=place, fleet=fleet,
        record=record,
    )


def answers(base: DataFrame) -> DataFrame:
    return base.select("usdot_number", answer_sentence().alias("answer"))


def faq_list() -> Column:
    """Two questions with answers, three when there are violations."""
    name, dot = F.col("name"), F.col("usdot_number")

    def entry(q: Column, a: Column) -> Column:
        return F.struct(q.alias("q"), a.alias("a"))

    what = entry(_fill(FAQ_WHAT, dot=dot), answer_sentence())
    how_many = entry(
        _fill(FAQ_HOW_MANY, name=name),
        _fill(
            FAQ_VIOLATIONS, name=name, violations=c.thousands("violations_total"),
            inspections=c.thousands("inspections_total"),
        ),
    )
    status = F.col("authority_status")
    allowed = entry(
        _fill(FAQ_ALLOWED, name=name),
        F.when(status.isNotNull(), _fill(FAQ_STATUS, name=name, status=status)).otherwise(
            _fill(FAQ_NO_STATUS, name=name, dot=dot)
        ),
    )
    asked = F.when(F.col("violations_total") > 0, how_many)
    return F.filter(F.array(what, asked, allowed), lambda e: e.isNotNull())


def faqs(base: DataFrame) -> DataFrame:
    return base.select("usdot_number", faq_list().alias("faqs"))


def carrier_url(site: str = DEFAULT_SITE) -> Column:
    return F.concat(F.lit(f"{site}/carrier/"), F.col("slug"))


def organization_json(site: str = DEFAULT_SITE) -> Column:
    """Organization document; absent fields are left out by the JSON writer."""
    located = F.col("address").isNotNull() | F.col("city").isNotNull()
    address = F.struct(
        F.lit("PostalAddress").alias("@type"),
        F.col("address").alias("streetAddress"),
        F.col("city").alias("addressLocality"),
        F.col("state").alias("addressRegion"),
        F.col("zip").alias("postalCode"),
        F.lit("US").alias("addressCountry"),
    )
    return F.to_json(
        F.struct(
            F.lit("https://schema.org").alias("@context"),
            F.lit("Organization").alias("@type"),
            F.col("name").alias("name"),
            F.col("dba_name").alias("alternateName"),
            F.concat(F.lit("USDOT "), F.col("usdot_number")).alias("identifier"),
            carrier_url(site).alias("url"),
            F.col("phone").alias("telephone"),
            F.when(located, address).alias("address"),
        )
    )


def state_url(site: str = DEFAULT_SITE) -> Column:
    return F.concat(F.lit(f"{site}/state/"), F.lower("state_code"))


def _crumb(position: Column, name: Column, item: Column) -> Column:
    return F.struct(
        F.lit("ListItem").alias("@type"), position.alias("position"), name.alias("name"),
        item.alias("item"),
    )


def breadcrumb_json(site: str = DEFAULT_SITE) -> Column:
    """Home, state page if the state has one, carrier."""
    has_page = F.col("state_code").isNotNull()
    home = _crumb(F.lit(1), F.lit("Home"), F.lit(site))
    state = F.when(
        has_page,
        _crumb(
            F.lit(2), F.col("state_name"), state_url(site)
        ),
    )
    carrier = _crumb(F.when(has_page, 3).otherwise(2), F.col("name"), carrier_url(site))
    return F.to_json(
        F.struct(
            F.lit("https://schema.org").alias("@context"),
            F.lit("BreadcrumbList").alias("@type"),
            F.filter(F.array(home, state, carrier), lambda x: x.isNotNull()).alias(
                "itemListElement"
            ),
        )
    )


def faq_json() -> Column:
    questions = F.transform(
        faq_list(),
        lambda e: F.struct(
            F.lit("Question").alias("@type"),
            e["q"].alias("name"),
            F.struct(F.lit("Answer").alias("@type"), e["a"].alias("text")).alias("acceptedAnswer"),
        ),
    )
    return F.to_json(
        F.struct(
            F.lit("https://schema.org").alias("@context"),
            F.lit("FAQPage").alias("@type"),
            questions.alias("mainEntity"),
        )
    )


def page_metadata(base: DataFrame) -> DataFrame:
    name, dot = F.col("name"), F.col("usdot_number")
    based = _or_nothing(F.col("state").isNotNull(), _fill(PAGE_BASED, state=F.col("state")))
    return base.select(
        "usdot_number",
        _fill(PAGE_TITLE, name=name, dot=dot).alias("title"),
        _fill(PAGE_DESCRIPTION, name=name, dot=dot, based=based).alias("description"),
        F.concat(F.lit("/carrier/"), F.col("slug")).alias("canonical"),
    )


def coverage_text() -> Column:
    """Where a carrier operates; null when its operation type is unknown."""
    kind = F.col("operation_type")
    home = F.coalesce("state_name", "state", F.lit(COVERAGE_UNKNOWN_HOME))
    return F.when(kind == "Interstate", F.lit(COVERAGE_ALL)).when(
        kind.isNotNull(), _fill(COVERAGE_HOME, home=home, kind=kind)
    )


def coverage(base: DataFrame) -> DataFrame:
    headquarters = F.when(
        F.col("city").isNotNull(),
        F.concat(F.col("city"), F.lit(", "), F.coalesce("state_name", "state", F.lit(""))),
    )
    return base.select(
        "usdot_number", headquarters.alias("headquarters"), coverage_text().alias("coverage")
    )


def ranked_offers(base: DataFrame, alerts: DataFrame, partner_urls: dict[str, str]) -> DataFrame:
    """The two best offers per carrier among the configured partners.

    `alerts` is one row per scored carrier with `any_alert`.
    """
    rate = c.violation_rate("violations_total", "inspections_total")
    troubled = F.coalesce("any_alert", F.lit(False)) | (rate >= POOR_RATE)

    def choice(order: tuple[str, ...]) -> Column:
        kept = [
            F.struct(F.lit(o).alias("category"), F.lit(partner_urls[o]).alias("url"))
            for o in order
            if partner_urls.get(o)
        ][:OFFERS_SHOWN]
        return F.array(*kept) if kept else F.array().cast("array<struct<category:string,url:string>>")

    offers = (
        F.when(troubled, choice(OFFERS_TROUBLED))
        .when(F.col("total_vehicles") <= SMALL_FLEET, choice(OFFERS_SMALL))
        .otherwise(choice(OFFERS_OTHER))
    )
    joined = base.join(alerts, "usdot_number", "left")
    return joined.select("usdot_number", offers.alias("offers"))


def carrier_documents(
    base: DataFrame, site: str = DEFAULT_SITE
) -> DataFrame:
    """All texts and documents of every carrier in one projection."""
    return base.select(
        "usdot_number",
        answer_sentence().alias("answer"),
        faq_list().alias("faqs"),
        organization_json(site).alias("organization_json"),
        breadcrumb_json(site).alias("breadcrumb_json"),
        faq_json().alias("faq_json"),
        coverage_text().alias("coverage"),
    )


def state_positions(carriers: DataFrame) -> DataFrame:
    """Every active carrier's place in its state's listing: page and position.

    Pages hold 25 carriers; `listed` marks the first ten of a page, which the page's
    structured data names.
    """
    active = with_state_name(carriers.where("is_active")).where(
        F.col("state_code").isNotNull() & (F.col("state") == F.col("state_code"))
    )
    ranked = fleet_rank(active, group=("state",), name="position")
    index = F.col("position") - 1
    return ranked.select(
        "state",
        "state_name",
        (F.floor(index / STATE_PAGE) + 1).alias("page"),
        "position",
        (index % STATE_PAGE < STATE_ITEMS).alias("listed"),
        "usdot_number",
        c.display_name().alias("name"),
        "slug",
    )


def state_item_lists(carriers: DataFrame, site: str = DEFAULT_SITE) -> DataFrame:
    """One ItemList document per state page, also for states without any carrier."""
    positions = state_positions(carriers)
    item = F.struct(
        F.lit("ListItem").alias("@type"),
        "position",
        "name",
        carrier_url(site).alias("url"),
    )
    # At most ten items come together per page.
    pages = (
        positions.where("listed")
        .groupBy("state", "page")
        .agg(F.collect_list(F.struct("position", item.alias("item"))).alias("raw"))
        .select("state", "page", F.transform(F.array_sort("raw"), lambda x: x["item"]).alias("items"))
    )
    # Counted apart from the ranks, so that ranks are drawn once.
    totals = carriers.where("is_active").groupBy("state").agg(F.count("*").alias("total"))
    none = F.array().cast(pages.schema["items"].dataType)
    states = state_table(carriers.sparkSession)
    return (
        states.join(totals, F.col("state_code") == totals["state"], "left")
        .drop("state")
        .join(pages, F.col("state_code") == pages["state"], "left")
        .select(
            F.col("state_code").alias("state"),
            F.coalesce("page", F.lit(1)).cast("bigint").alias("page"),
            F.to_json(
                F.struct(
                    F.lit("https://schema.org").alias("@context"),
                    F.lit("ItemList").alias("@type"),
                    _fill(STATE_LIST_NAME, state=F.col("state_name")).alias("name"),
                    F.coalesce("total", F.lit(0)).alias("numberOfItems"),
                    F.coalesce("items", none).alias("itemListElement"),
                )
            ).alias("document"),
        )
    )


def sitemap_urls(
    carriers: DataFrame, site: str = DEFAULT_SITE, per_file: int = PAGE_SIZE
) -> DataFrame:
    """(file, position, url): file 0 the fixed pages, 1 and up the carriers."""
    spark: SparkSession = carriers.sparkSession
    fixed = spark.sql(
        "select posexplode(array("
        + ", ".join(f"'{site}{p}'" for p in STATIC_PAGES)
        + ")) as (position, url)"
    )
    states = state_table(spark).select(
        # State pages follow the fixed ones, in the order of the state table.
        (F.lit(len(STATIC_PAGES)) + F.array_position(_codes(), F.col("state_code")) - 1).alias("position"),
        state_url(site).alias("url"),
    )
    profiles = slug_pages(carriers, per_file).select(
        (F.col("page") + 1).alias("file"), "position", carrier_url(site).alias("url")
    )
    first = fixed.unionByName(states).select(
        F.lit(0).cast("bigint").alias("file"), F.col("position").cast("bigint").alias("position"), "url"
    )
    return first.unionByName(profiles)


def _codes() -> Column:
    return F.array(*[F.lit(code) for code in STATE_NAMES])


def sitemap_files(
    carriers: DataFrame, site: str = DEFAULT_SITE, per_file: int = PAGE_SIZE
) -> DataFrame:
    """(file, xml); a file holds at most 50,000 urls by the format's own rule."""
    entry = F.concat(F.lit("<url><loc>"), c.xml_escape("url"), F.lit("</loc></url>"))
    return (
        sitemap_urls(carriers, site, per_file)
        .groupBy("file")
        .agg(F.collect_list(F.struct("position", entry.alias("entry"))).alias("e"))
        .select(
            "file",
            F.concat(
                F.lit(URLSET_HEAD),
                F.array_join(F.transform(F.array_sort("e"), lambda x: x["entry"]), ""),
                F.lit("</urlset>"),
            ).alias("xml"),
        )
    )


def sitemap_index(
    carriers: DataFrame, site: str = DEFAULT_SITE, per_file: int = PAGE_SIZE
) -> DataFrame:
    """(file, url) of the index. It counts active carriers whether or not they have a
    slug, so it may name more files than there are."""
    active = carriers.agg(F.count_if("is_active").alias("n"))
    last = F.greatest(F.lit(1), F.ceil(F.col("n") / per_file)).cast("bigint")
    return active.select(F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("file")).select(
        "file", F.concat(F.lit(f"{site}/sitemaps/"), F.col("file").cast("string")).alias("url")
    )


def sitemap_index_xml(
    carriers: DataFrame, site: str = DEFAULT_SITE, per_file: int = PAGE_SIZE
) -> DataFrame:
    entry = F.concat(F.lit("<sitemap><loc>"), c.xml_escape("url"), F.lit("</loc></sitemap>"))
    rows = sitemap_index(carriers, site, per_file).agg(
        F.array_sort(F.collect_list(F.struct("file", entry.alias("entry")))).alias("e")
    )
    return rows.select(
        F.concat(
            F.lit(INDEX_HEAD),
            F.array_join(F.transform("e", lambda x: x["entry"]), ""),
            F.lit("</sitemapindex>"),
        ).alias("xml")
    )
