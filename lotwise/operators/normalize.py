"""Normalization: brand/model dictionary, vocabularies, ranges, currency, keys."""
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lotwise import rules as R
from lotwise.functions import cols as C, text as T

JACCARD_AT = 0.8


def brand_models(spark: SparkSession) -> DataFrame:
    """The seed dictionary as a table."""
    return spark.createDataFrame(
        [(i, b, m, nb, nm, list(al), True) for i, (b, m, nb, nm, al) in enumerate(R.BRAND_MODELS)],
        "ord int, brand string, model string, normalized_brand string, normalized_model string, aliases array<string>, active boolean")


def alias_dictionary(mappings: DataFrame) -> DataFrame:
    """One row per model and alias spelling; a repeated key keeps its first place and its last value."""
    keys = mappings.filter("active").select(
        F.lower("brand").alias("brand_key"), "normalized_brand", "normalized_model", "ord",
        F.posexplode(F.concat(F.array("model"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias_pos", "model_key"),
    ).withColumns({"model_key": F.lower("model_key"), "place": F.struct("ord", "alias_pos")})
    return keys.groupBy("brand_key", "model_key").agg(
        F.max_by("normalized_brand", "place").alias("norm_brand"), F.max_by("normalized_model", "place").alias("norm_model"),
        F.min("place").alias("ord"))


def _distinct_pairs(df: DataFrame, brand: str, model: str) -> DataFrame:
    known = C.text(F.col(brand)).isNotNull() & C.text(F.col(model)).isNotNull()
    return df.filter(known).select(F.col(brand).alias("b_raw"), F.col(model).alias("m_raw")).distinct().withColumns(
        {"b": T.text_clean(F.col("b_raw")), "m": T.text_clean(F.col("m_raw"))})


def alias_lookup(df: DataFrame, dictionary: DataFrame, brand: str = "make", model: str = "model_raw") -> DataFrame:
    """Exact dictionary look-up; unknown pairs get NULL, NULL."""
    pairs = _distinct_pairs(df, brand, model)
    hit = pairs.join(dictionary, (F.col("b") == F.col("brand_key")) & (F.col("m") == F.col("model_key"))) \
        .select("b_raw", "m_raw", "norm_brand", "norm_model")
    return _attach(df, hit, brand, model)


def _attach(df, resolved, brand, model):
    return df.join(resolved, (F.col(brand) == F.col("b_raw")) & (F.col(model) == F.col("m_raw")), "left").drop("b_raw", "m_raw")


def fuzzy_jaccard_join(df: DataFrame, dictionary: DataFrame, brand: str = "make", model: str = "model_raw",
                       threshold: float = JACCARD_AT) -> DataFrame:
    """Exact look-up, else the first dictionary entry of the brand whose token set is similar enough.

    Only distinct (brand, model) spellings meet the dictionary.
    """
    pairs = _distinct_pairs(df, brand, model)
    near = pairs.join(dictionary, F.col("b") == F.col("brand_key")).withColumn("exact", F.col("m") == F.col("model_key"))
    similar = near.filter(F.col("exact") | (T.jaccard(T.tokens(F.col("m")), T.tokens(F.col("model_key"))) >= threshold))
    best = similar.groupBy("b_raw", "m_raw").agg(
        F.min_by(F.struct("norm_brand", "norm_model"), F.struct((~F.col("exact")).cast("int"), "ord")).alias("n"))
    return _attach(df, best.select("b_raw", "m_raw", "n.*"), brand, model)


def _map(words) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(words)])


def enum_value(col: Column, words) -> Column:
    return F.element_at(_map(words), F.lower(T.strip(col)))


def enum_map(df: DataFrame) -> DataFrame:
    return df.withColumns({"fuel": enum_value(F.col("fuel_raw"), R.FUEL_WORDS),
                           "gearbox": enum_value(F.col("gearbox_raw"), R.GEARBOX_WORDS),
                           "body": enum_value(F.col("body_raw"), R.BODY_WORDS)})


def range_validity(df: DataFrame, as_of_year: Column) -> DataFrame:
    return df.withColumns({
        "mileage_km": F.when(F.col("mileage_km").between(0, 1_000_000), F.col("mileage_km")),
        "year": F.when(F.col("year").between(F.lit(1900), as_of_year + 1), F.col("year"))})


def to_bgn(price: Column, currency: Column) -> Column:
    rate = F.coalesce(F.element_at(_map(R.FX_TO_BGN), F.upper(currency)), F.lit(1.0))
    return F.round(price * rate, 2)


def fx_convert(df: DataFrame) -> DataFrame:
    return df.withColumn("price_in_bgn", to_bgn(F.col("price_bgn"), F.coalesce("currency", F.lit("BGN"))))


def seller_key(df: DataFrame, name: str, location: str, phone: str) -> DataFrame:
    """Phone hashes of both sources and the seller hash: name, else location, else phone."""
    local = T.strip(F.replace(F.replace(F.col(phone), F.lit("tel:"), F.lit("")), F.lit("+359"), F.lit("0")))
    phone_md5 = F.md5(local)
    who = F.coalesce(C.text(F.col(name)), C.text(F.col(location)), phone_md5, F.lit("unknown"))
    return df.withColumns({"phone_sha": F.sha2(F.col(phone), 256), "phone_hash": phone_md5,
                           "seller_hash": F.md5(F.concat(F.lit("cars_bg_"), who))})


def dictionary_mining(df: DataFrame, dictionary: DataFrame, brand: str = "brand_id", model: str = "model_id",
                      minimum: int = 2, top: int = 1000) -> DataFrame:
    """New dictionary rows: frequent (brand, model) pairs, cleaned, not mapped yet."""
    usable = F.lit(True)
    for c in (brand, model):
        usable = usable & F.col(c).isNotNull() & (F.col(c) != "") & (F.col(c) != "None")
    frequent = df.filter(usable).groupBy(F.col(brand).alias("brand"), F.col(model).alias("model")) \
        .agg(F.count(F.lit(1)).alias("listings")).filter(F.col("listings") >= minimum) \
        .orderBy(F.col("listings").desc(), "brand", "model").limit(top)
    clean = lambda c: F.lower(T.strip(F.regexp_replace(c, r"(?U)[^\w\s-]", "")))
    mined = frequent.withColumns({"norm_brand": clean(F.col("brand")), "norm_model": clean(F.col("model"))}).filter(
        (F.length("norm_brand") >= 2) & (F.length("norm_model") >= 1)
        & (F.col("norm_brand") != "unknown") & (F.col("norm_model") != "unknown"))
    known = dictionary.select(F.lower("brand").alias("kb"), F.lower("model").alias("km")).distinct()
    return mined.join(known, (F.lower("brand") == F.col("kb")) & (F.lower("model") == F.col("km")), "left_anti")


def brand_urls(brands: DataFrame, base: str) -> DataFrame:
    """Slug, search address and priority flag of each brand."""
    slug = F.translate(F.lower("brand"), " &ëüöä.", "--euoa")
    return brands.withColumns({"slug": slug, "url": F.concat(F.lit(base), slug),
                               "priority": F.col("brand").isin(*R.PRIORITY_BRANDS)})


def normalize_listings(df: DataFrame, dictionary: DataFrame, as_of_year: Column) -> DataFrame:
    """The normalization stage: dictionary, vocabularies, ranges, currency, content hash, version."""
    named = fuzzy_jaccard_join(df, dictionary)
    out = fx_convert(range_validity(enum_map(named), as_of_year))
    version = F.col("listing_version") if "listing_version" in df.columns else F.lit(0)
    return out.withColumns({"description_hash": F.when(C.text(F.col("description")).isNotNull(), T.content_hash(F.col("description"))),
                            "listing_version": version + 1})
