"""Page-to-row extraction as Column expressions over a table [page_id, url, html]."""
from pyspark.sql import Column, DataFrame, functions as F

from lotwise import rules as R
from lotwise.functions import cols as C, html as H
from lotwise.functions.text import squeeze, strip

LD_SCHEMA = "name string, description string, offers struct<price:string,priceCurrency:string>, image string"
SITE = "https://www.mobile.bg"


def url_fields(df: DataFrame) -> DataFrame:
    pattern = r"obiava-\d+-([^-]+)-([^-/\s]+)"
    return df.withColumns({"url_brand": H.found(F.col("url"), pattern, 1), "url_model": H.found(F.col("url"), pattern, 2)})


def table_entries(html: Column) -> Column:
    """Two-cell rows as array<struct<key,value>> in page order."""
    rows = H.all_of(html, r"(?s)<tr[^>]*>(.*?)</tr>")
    cells = F.transform(rows, lambda r: H.all_of(r, r"(?s)<td[^>]*>(.*?)</td>"))
    return F.transform(F.filter(cells, lambda c: F.size(c) == 2), lambda c: F.struct(
        F.regexp_replace(H.plain(c[0]), ":+$", "").alias("key"), H.plain(c[1]).alias("value")))


def entry(entries: Column, key: str) -> Column:
    """Value of a key; the last row wins."""
    return F.try_element_at(F.filter(entries, lambda e: e["key"] == key), F.lit(-1))["value"]


def header_value(html: Column, label: str) -> Column:
    """Text of the cell that follows the first header cell holding the label."""
    pairs = F.transform(H.all_of(html, r"(?s)(<th[^>]*>.*?</th>\s*<td[^>]*>.*?</td>)"), lambda p: F.struct(
        H.plain(F.regexp_extract(p, r"(?s)<th[^>]*>(.*?)</th>", 1)).alias("k"),
        H.plain(F.regexp_extract(p, r"(?s)<td[^>]*>(.*?)</td>", 1)).alias("v")))
    return F.try_element_at(F.filter(pairs, lambda p: F.contains(p["k"], F.lit(label))), F.lit(1))["v"]


def with_entries(df: DataFrame) -> DataFrame:
    return df.withColumn("entries", table_entries(F.col("html")))


def title_year(df: DataFrame) -> DataFrame:
    """Needs entries."""
    title = H.tag_text(F.col("html"), "title")
    table_year = F.coalesce(entry(F.col("entries"), R.PAGE_KEYS["year"]), entry(F.col("entries"), R.PAGE_KEYS["first_reg"]))
    return df.withColumn("page_title", title).withColumn("year", F.coalesce(
        H.found(F.col("page_title"), r"(\d{4})\s*г").try_cast("int"), H.found(table_year, r"(\d{4})").try_cast("int")))


def max_price(df: DataFrame) -> DataFrame:
    """Largest number followed by a currency mark; the first one wins a tie."""
    pattern = r"(?U)(\d[\d\s]{3,})\s*(лв|€|EUR)"
    number, mark = H.all_of(F.col("html"), pattern, 1), H.all_of(F.col("html"), pattern, 2)
    priced = F.transform(F.arrays_zip(number.alias("n"), mark.alias("c")), lambda x, i: F.struct(
        strip(F.replace(x["n"], F.lit(" "), F.lit(""))).try_cast("bigint").alias("price"), (-i).alias("place"), x["c"].alias("mark")))
    best = F.array_max(F.filter(priced, lambda p: p["price"].isNotNull()))
    return df.withColumn("best", best).withColumns({
        "price": F.col("best.price"),
        "currency": F.when(F.col("best.mark").isin("€", "EUR"), "EUR").otherwise("BGN")}).drop("best")


def brand_fallback(df: DataFrame) -> DataFrame:
    """Needs url_brand, url_model, entries, page_title."""
    brand = F.coalesce(C.text(F.col("url_brand")), C.text(entry(F.col("entries"), R.PAGE_KEYS["brand"])))
    model = F.coalesce(C.text(F.col("url_model")), entry(F.col("entries"), R.PAGE_KEYS["model"]))
    words = F.filter(F.split(F.get(F.split("page_title", ","), F.lit(0)), r"(?U)\s+"), lambda w: w != "")
    from_title = brand.isNull() & (F.length("page_title") > 0)
    return df.withColumns({
        "brand": F.when(from_title, F.get(words, F.lit(0))).otherwise(brand),
        "model": F.when(from_title & (F.size(words) > 1), F.array_join(F.slice(words, 2, 2), " ")).otherwise(model)})


def numeric_fields(df: DataFrame) -> DataFrame:
    """Needs entries: mileage, power, volume."""
    km = F.replace(entry(F.col("entries"), R.PAGE_KEYS["mileage"]), F.lit("км"), F.lit(""))
    engine = entry(F.col("entries"), R.PAGE_KEYS["engine"])
    return df.withColumns({"mileage_km": H.digits(H.found(km, r"(?U)([\d\s]+)")),
                           "power_hp": H.found(engine, r"(\d+)\s*к\.с").try_cast("int"),
                           "volume_cc": H.found(engine, r"(\d+)\s*куб").try_cast("int")})


def class_fields(df: DataFrame) -> DataFrame:
    html = F.col("html")
    return df.withColumns({"description": H.class_text(html, "description", "adPage__content__description"),
                           "phone": H.class_text(html, "phone", "adPage__phone"),
                           "seller": H.class_text(html, "sellerName", "adPage__seller__name")})


def images(df: DataFrame, limit: int = 5) -> DataFrame:
    """Full-size, absolute, distinct image addresses of the gallery, in page order."""
    tags = F.flatten(F.transform(H.class_blocks(F.col("html"), "pic", "adPage__gallery", "thumbs"), lambda b: H.all_of(b, "<img[^>]*>", 0)))
    src = F.transform(tags, lambda t: F.coalesce(H.attribute(t, "src"), H.attribute(t, "data-src"), F.lit("")))
    kept = F.filter(src, lambda s: (s != "") & ~F.contains(s, F.lit("no-image")))
    full = F.transform(kept, lambda s: F.replace(F.replace(s, F.lit("_Small"), F.lit("")), F.lit("_Thumb"), F.lit("")))
    absolute = F.transform(full, lambda s: F.when(F.startswith(s, F.lit("//")), F.concat(F.lit("https:"), s))
                           .when(F.startswith(s, F.lit("/")), F.concat(F.lit(SITE), s)).otherwise(s))
    return df.withColumn("images", F.slice(F.array_distinct(absolute), 1, limit))


def page_fields(df: DataFrame) -> DataFrame:
    """The whole first-source parser."""
    out = images(class_fields(numeric_fields(max_price(brand_fallback(title_year(url_fields(with_entries(df))))))))
    value = lambda k: entry(F.col("entries"), R.PAGE_KEYS[k])
    return out.withColumns({"fuel_raw": value("fuel"), "gearbox_raw": value("gearbox"), "body_raw": value("body"),
                            "color": value("color"), "region": value("region")})


def model_string_split(df: DataFrame, column: str = "model") -> DataFrame:
    """Engine size, power, fuel marker, base model and trim list of a model string."""
    s = strip(F.col(column))
    head = F.slice(F.split(s, r"(?U)[\s/]+"), 1, 3)
    markers = C.words(R.ENGINE_STOP)
    stops = F.transform(head, lambda p, i: ~((i == 0) & p.rlike(r"^\d{3}[dDi]$")) & (
        ((i > 0) & F.exists(markers, lambda m: F.contains(F.upper(p), m))) | p.rlike(r"(?i)^(" + "|".join(R.TRIM_STOP) + ")$")))
    at = F.array_position(stops, True)
    base = F.slice(head, F.lit(1), F.when(at > 0, at - 1).otherwise(F.size(head)).cast("int"))
    trims = F.filter(C.words(R.TRIM_WORDS), lambda t: F.contains(F.lower(s), F.lower(t)))
    return df.withColumns({
        "engine_size": H.found(s, r"\b(\d+\.\d+)\b").try_cast("double"),
        "power_hp": H.found(s, r"(?iu)[(\[]?\s*(\d{2,3})\s*(?:hp|к\.с\.|к\.с|PS|ch)\s*[)\]]?").try_cast("int"),
        "engine_type": C.first_word_hit(s, R.ENGINE_MARKERS),
        "model_base": F.when(F.size(base) > 0, F.array_join(base, " ")),
        "trim": F.when(F.size(trims) > 0, F.array_join(trims, "/"))})


def price_text(text: Column) -> tuple[Column, Column]:
    """(price, currency) of a price text: BGN first, else EUR; decimals dropped."""
    number = r"(?U)(\d+(?:[\s ]+\d+)*(?:\.\d+)?)\s*"
    whole = lambda hit: H.digits(F.regexp_replace(hit, r"\..*$", ""))
    bgn, eur = H.found(text, number + "лв"), H.found(text, number + "€")
    return F.when(bgn.isNotNull(), whole(bgn)).otherwise(whole(eur)), F.when(bgn.isNull() & eur.isNotNull(), "EUR").otherwise("BGN")


def live_pages(df: DataFrame) -> DataFrame:
    """Drops pages that say the listing was deleted; the filter reads the page once, so one made by an expression is made once for it."""
    exact, word = R.DELETED_MARKERS
    return df.filter(H.bound(F.col("html"), lambda page: ~F.contains(page, F.lit(exact)) & ~F.contains(F.lower(page), F.lit(word))))


def _class_like(html: Column, part: str) -> Column:
    return H.plain(H.found(html, rf'(?s)<\w+[^>]*class="[^"]*{part}[^"]*"[^>]*>([^<]*)<'))


def listing_detail(df: DataFrame) -> DataFrame:
    """First-source detail row from the rendered page.

    Texts that several fields need are columns of their own first, so each
    pattern runs once per page.
    """
    html = F.col("html")
    first = live_pages(df).withColumns({
        "site_ad_id": H.found(F.col("url"), r"/obiava-(\d+)"),
        "title": F.coalesce(H.tag_text(html, "h1"), F.lit("")),
        "price_text": F.array_join(F.transform(H.class_blocks(html, "Price"), lambda b: H.plain(b, " ")), " "),
        "phone_text": H.class_text(html, "phone"), "text": H.first_text(html, "description", "adDescription"),
        "place": H.class_text(html, "region", "location")}).filter("site_ad_id is not null")
    first = first.withColumn("title", F.when(F.col("title") != "", F.col("title")).otherwise(
        F.coalesce(C.text(H.class_text(html, "adTitle", "title")), H.tag_text(html, "title"), F.lit(""))))
    words = F.filter(F.split("title", r"(?U)\s+"), lambda w: w != "")
    price, currency = price_text(F.col("price_text"))
    srcs = F.transform(H.all_of(html, "<img[^>]*>", 0), lambda t: F.coalesce(H.attribute(t, "src"), F.lit("")))
    shown = F.filter(srcs, lambda s: s.rlike("jpg|jpeg|png") & ~F.lower(s).rlike("logo|icon"))
    return first.withColumns({
        "brand": F.get(words, F.lit(0)), "model": F.when(F.size(words) > 1, F.array_join(F.slice(words, 2, 2), " ")),
        "price": price, "currency": currency, "year": H.found(html, r"(\d{4})\s*г").try_cast("int"),
        "mileage_km": H.digits(strip(H.found(html, r"(?U)([\d\s]+)\s*км"))),
        "fuel": C.first_word_hit(html, R.PAGE_FUEL), "gearbox": C.first_word_hit(html, R.PAGE_GEARBOX),
        "description": F.coalesce(C.text(F.col("text")), _class_like(html, "description"), F.lit("")),
        "images": shown, "phone_hash": F.sha2(F.coalesce(C.text(F.col("phone_text")), C.text(_class_like(html, "phone"))), 256),
        "region": F.coalesce(C.text(F.col("place")), C.text(_class_like(html, "location")))}).drop("price_text", "phone_text", "text", "place")


def jsonld(df: DataFrame) -> DataFrame:
    """Structured data block: name, description, price, currency, images (text or list)."""
    block = H.found(F.col("html"), r'(?s)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>')
    parsed = df.withColumn("ld", F.from_json(block, LD_SCHEMA))
    image = F.col("ld.image")
    return parsed.withColumns({
        "ld_name": F.col("ld.name"), "ld_description": F.col("ld.description"), "ld_price": F.col("ld.offers.price").try_cast("double"),
        "ld_currency": F.when(F.col("ld.name").isNotNull(), F.coalesce("ld.offers.priceCurrency", F.lit("BGN"))),
        "ld_images": F.when(image.startswith("["), F.from_json(image, "array<string>")).when(image.isNotNull(), F.array(image))}).drop("ld")


def sitemap_detail(df: DataFrame) -> DataFrame:
    """Structured data first, page markup as the fallback."""
    html = F.col("html")
    shown = H.plain(F.coalesce(F.try_element_at(H.class_blocks(html, "price", "adPage__price", "Price"), F.lit(1)), F.lit("")), " ")
    number, mark = H.found(shown, r"(?U)([\d\s]+)\s*(лв|EUR|€)", 1), H.found(shown, r"(?U)([\d\s]+)\s*(лв|EUR|€)", 2)
    out = jsonld(df)
    return out.withColumns({
        "site_ad_id": H.found(F.col("url"), r"/obiava-(\d+)"),
        "title": F.coalesce(C.text(F.col("ld_name")), H.tag_text(html, "h1")),
        "price": F.coalesce(F.col("ld_price"), H.digits(strip(number)).cast("double")),
        "currency": F.when(F.col("ld_price").isNotNull(), F.col("ld_currency")).when(mark.isin("EUR", "€"), "EUR").otherwise("BGN"),
        "year": H.found(html, r"(\d{4})\s*г").try_cast("int"), "mileage_km": H.found(html, r"(\d+)\s*км").try_cast("int"),
        "fuel": C.first_word_hit(html, R.PAGE_FUEL), "gearbox": C.first_word_hit(html, R.PAGE_GEARBOX)}).filter("site_ad_id is not null")


# --- second source --------------------------------------------------------------------
def title_brand(df: DataFrame, title: Column, brand: str, model: str) -> DataFrame:
    """Adds brand and model of a second-source title: dictionary scan, then text up to a comma or price, at most three words.

    Texts that several steps use are columns of their own, computed once.
    """
    c, text, upper = F.col, F.col("__text"), F.col("__upper")
    df = df.withColumn("__text", F.regexp_replace(title, r"(?i)CARS\.BG\s*-\s*", "")).withColumn("__upper", F.upper(text))
    df = df.withColumn(brand, C.first_word_hit(upper, [(F.upper(F.lit(b)), b) for b in R.TITLE_BRANDS]))
    after = strip(F.substring(text, F.position(F.upper(brand), upper) + F.length(brand), F.length(text)))
    df = df.withColumn("__raw", strip(H.found(after, r"(?i)^([A-Za-z0-9\-\s/\.]+?)(?:\s*,|\s+\d+\s*(?:BGN|EUR)|$)"))) \
        .withColumn("__words", F.filter(F.split("__raw", r"(?U)\s+"), lambda w: w != ""))
    short = F.when(F.size("__words") > 3, F.array_join(F.slice("__words", 1, 3), " ")).otherwise(c("__raw"))
    return df.withColumn(model, F.when(F.size("__words") > 0, strip(F.regexp_replace(short, r"[/\.\-]+$", "")))).drop("__text", "__upper", "__raw", "__words")


def brand_dictionary_scan(df: DataFrame, column: str = "title") -> DataFrame:
    return title_brand(df, F.col(column), "scan_brand", "scan_model").withColumn("scan_model", F.when(F.col("scan_brand").isNotNull(), F.col("scan_model")))


def clean_price(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\d.]", "").try_cast("double")


def clean_currency(text: Column) -> Column:
    up = F.upper(text)
    return F.when(up.contains("EUR") | up.contains("€"), "EUR").otherwise("BGN")


def clean_mileage(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "").try_cast("int")


def clean_fuel(text: Column) -> Column:
    return F.when(F.length(text) > 0, C.first_word_hit(F.upper(text), R.PAGE2_FUEL_UPPER, text))


def numeric_clean(df: DataFrame, price: str, mileage: str, fuel: str) -> DataFrame:
    return df.withColumns({"clean_price": clean_price(F.col(price)), "clean_currency": clean_currency(F.coalesce(F.col(price), F.lit(""))),
                           "clean_mileage": clean_mileage(F.col(mileage)), "clean_fuel": clean_fuel(F.col(fuel))})


def listing_detail_2(df: DataFrame) -> DataFrame:
    """Second-source detail row; shared texts are columns of their own first."""
    html, c = F.col("html"), F.col
    known = df.withColumn("site_ad_id", H.found(F.col("url"), r"/offer/([a-f0-9]+)")).filter("site_ad_id is not null")
    texts = known.withColumns({
        "page_title": H.tag_text(html, "title"), "heading": H.tag_text(html, "h2"), "copies": H.class_blocks(html, "text-copy"),
        "body_text": H.plain(F.regexp_extract(html, r"(?s)<body[^>]*>(.*)</body>", 1), " "), "near": _class_like(html, "location"),
        "tel": H.found(html, r'href="(tel:[^"]*)"')})
    from_title = F.when(c("page_title").contains("CARS.BG"), strip(F.get(F.split(F.replace("page_title", F.lit("CARS.BG - "), F.lit("")), ","), F.lit(0))))
    paragraphs = F.array_join(F.transform(H.all_of(html, r"(?s)<p[^>]*>(.*?)</p>"), lambda p: H.plain(p)), " ")
    priced = F.array_join(H.all_of(html, r'(?s)<\w+[^>]*class="[^"]*price[^"]*"[^>]*>([^<]*)<'), " ")
    bgn = lambda text: clean_price(H.found(text, r"(\d[\d\s,]*)\s*BGN"))
    eur = lambda text: clean_price(H.found(text, r"(\d[\d\s,.]*)\s*EUR"))
    shared = texts.withColumns({
        "title": F.coalesce(C.text(c("heading")), from_title, F.lit("")),
        "details": squeeze(F.coalesce(H.plain(F.try_element_at("copies", F.lit(1))), paragraphs)),
        "bgn1": bgn(c("page_title")), "eur1": eur(c("page_title")), "bgn2": bgn(priced), "eur2": eur(priced),
        "is_dealer": html.rlike(r"<td[^>]*>[^<]*Фирма") | c("body_text").contains("ООД"),
        "location": F.coalesce(F.when((F.length("near") > 2) & ~c("near").rlike(r"\d"), c("near")),
                               F.try_element_at(F.filter(C.words(R.PAGE2_CITIES), lambda w: F.contains("body_text", w)), F.lit(1))),
        "phone_hash": F.md5(strip(F.replace(F.replace("tel", F.lit("tel:"), F.lit("")), F.lit("+359"), F.lit("0"))))})
    shared = title_brand(shared, c("title"), "brand", "model").withColumns({"seller_name": F.when(~c("is_dealer"), C.text(_class_like(html, "seller")))})
    d = c("details")
    month = "(?:" + "|".join(R.MONTHS) + ")"
    srcs = F.transform(H.all_of(html, "<img[^>]*>", 0), lambda t: F.coalesce(H.attribute(t, "src"), F.lit("")))
    shown = F.filter(srcs, lambda s: F.contains(s, F.lit("cars.bg")) & F.contains(s, F.lit("/2")) & F.contains(s, F.lit("http")))
    rest = F.array_join(F.filter(F.transform(F.slice("copies", F.lit(2), F.size("copies")), lambda b: H.plain(b)), lambda t: t != ""), " ")
    return shared.withColumns({
        "listing_hash": F.md5(F.concat(F.lit("cars_bg_"), "site_ad_id")), "model": F.when(c("brand").isNotNull(), c("model")),
        "price": F.coalesce("bgn1", "eur1", "bgn2", "eur2"),
        "currency": F.when(c("bgn1").isNull() & (c("eur1").isNotNull() | (c("bgn2").isNull() & c("eur2").isNotNull())), "EUR").otherwise("BGN"),
        "year": F.coalesce(H.found(d, month + r"\s+(\d{4})"), H.found(d, r"\b((?:19|20)\d{2})\b")).try_cast("int"),
        "mileage_km": clean_mileage(H.found(d, r"(?iu)(\d[\d\s]*)\s*км")),
        "fuel": C.first_word_hit(d, R.PAGE2_FUEL), "gearbox": C.first_word_hit(d, R.PAGE2_GEARBOX),
        "power_hp": H.found(d, r"(\d+)\s*к\.с\.").try_cast("int"), "engine_cc": H.found(d, r"(\d+)\s*см3").try_cast("int"),
        "color": H.found(d, r",\s*([А-Яа-я]+)\s*$"), "body": C.first_word_hit(d, R.PAGE2_BODY),
        "condition": F.when(d.contains("Нов автомобил"), "New").otherwise("Used"),
        "seller_hash": F.md5(F.concat(F.lit("cars_bg_"), F.coalesce("seller_name", "location", "phone_hash", F.lit("unknown")))),
        "description": F.when(F.size("copies") > 1, rest).otherwise(d), "images": F.array_distinct(shown),
    }).drop("page_title", "heading", "copies", "body_text", "near", "tel", "details", "bgn1", "eur1", "bgn2", "eur2")


# --- links ------------------------------------------------------------------------------
def is_listing_url(url: Column) -> Column:
    excluded = F.exists(C.words(R.URL_EXCLUDED), lambda w: F.contains(F.lower(url), w))
    return F.coalesce((F.length(url) > 0) & ~excluded & url.rlike(r"^(?:(?!/obiava-).)*/obiava-\d{17,}(?:-|$|/obiava-)"), F.lit(False))


def listing_url_id(url: Column) -> Column:
    """Text between ``obiava-`` and the next hyphen, of the first path part that starts so."""
    part = F.try_element_at(F.filter(F.split(url, "/"), lambda p: F.startswith(p, F.lit("obiava-"))), F.lit(1))
    return F.get(F.split(F.replace(part, F.lit("obiava-"), F.lit("")), "-"), F.lit(0))


def url_predicate(df: DataFrame, column: str = "url") -> DataFrame:
    return df.withColumns({"is_listing": is_listing_url(F.col(column)), "url_id": listing_url_id(F.col(column))})


def outlinks(df: DataFrame) -> DataFrame:
    """One row per distinct absolute link of a page."""
    links = F.array_distinct(F.transform(H.hrefs(F.col("html")), lambda u: H.absolute(u, F.col("url"))))
    return df.select("page_id", F.posexplode(links).alias("position", "link"))


def page_max_link(df: DataFrame, parameter: str = "page") -> DataFrame:
    """Highest page number among the links of a page."""
    numbers = F.transform(F.filter(F.transform(H.hrefs(F.col("html")), lambda u: F.regexp_extract(u, rf"{parameter}=(\d+)", 1)), lambda x: x != ""),
                          lambda x: x.try_cast("int"))
    return df.withColumn("max_page", F.array_max(numbers))


def link_slugs(df: DataFrame, prefix: str) -> DataFrame:
    """Slugs of links below a prefix: generic ones dropped, distinct, long or empty names replaced by the slug.

    df[page_id, url, html]; the first link of a slug gives its name.
    """
    anchors = H.all_of(F.col("html"), r"(?s)(<a\s[^>]*>.*?</a>)")
    seen = df.select("page_id", F.posexplode(anchors).alias("place", "a")).select(
        "page_id", "place", H.found(H.attribute(F.col("a"), "href"), rf"{prefix}([^/]+)").alias("slug"), H.plain(F.col("a")).alias("name"))
    usable = seen.filter(F.col("slug").isNotNull() & ~F.col("slug").isin(*R.GENERIC_SLUGS))
    first = usable.groupBy("slug").agg(F.min_by("name", F.struct("page_id", "place")).alias("name"), F.min("page_id").alias("page_id"))
    return first.withColumn("name", F.when((F.col("name") == "") | (F.length("name") > 50), F.col("slug")).otherwise(F.col("name")))
