"""Dataset schemas and the fixed vocabularies every operator shares."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values (must equal the source system's for identical results) ---
# Score categories, in this order everywhere.
CATEGORIES = [
    "romance",
    "family",
    "cost",
    "nature",
    "adventure",
    "culture",
    "food",
    "relaxation",
    "service",
    "accessibility",
]

# Filler phrases that mark a description as carrying no information.
PLACEHOLDER_PHRASES = [
    "not mentioned in this text",
    "no specific details",
    "no direct information",
    "no specific description available",
    "no description available",
    "there is no specific description",
    "not enough information",
]

# Null-like text values (update variant / agent variant adds "n/a").
NULL_LIKE = ["nan", "none", "null"]
NULL_LIKE_AGENT = ["nan", "none", "null", "n/a"]

# Placeholder strings a CSV reader turns into NULL (pandas' default NA set).
CSV_NA_VALUES = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]

# URL fragments that mark a link as navigation rather than an article.
LINK_EXCLUDE = ["/tag/", "/category/", "/page/", "facebook.com", "instagram.com"]

# HTML elements whose whole subtree is dropped before text extraction.
HTML_DROP_TAGS = ["script", "style", "nav", "footer", "header", "aside", "form"]

# Categories offered (in this display order) as filters and labels in the
# planner; service and accessibility are not offered.
THRESHOLD_CATEGORIES = ["nature", "adventure", "culture", "food", "romance", "family", "cost", "relaxation"]
# --- end of fixed values ---

SCORES = T.StructType([T.StructField(c, T.DoubleType()) for c in CATEGORIES])

NEW_DATA = T.StructType(
    [
        T.StructField(c, T.StringType())
        for c in [
            "country",
            "place",
            "description",
            "region",
            "place_type",
            "google_maps_url",
            "source",
            "blog_source",
        ]
    ]
    + [T.StructField("review_date", T.TimestampType()), T.StructField("is_manual_entry", T.BooleanType())]
    + list(SCORES.fields)
)

LABELLED_REVIEW = T.StructType(
    [
        T.StructField("review_id", T.StringType()),
        T.StructField("review", T.StringType()),
        T.StructField("distribution", T.MapType(T.StringType(), T.IntegerType())),
    ]
)

SOURCE_REGISTRY = T.StructType(
    [
        T.StructField("blog_name", T.StringType()),
        T.StructField("base_url", T.StringType()),
        T.StructField(
            "destinations",
            T.ArrayType(
                T.StructType(
                    [T.StructField("country", T.StringType()), T.StructField("category_url", T.StringType())]
                )
            ),
        ),
    ]
)

EXTRACTED_PLACE = T.StructType(
    [
        T.StructField(c, T.StringType())
        for c in ["place", "country", "region", "place_type", "google_maps_url", "description"]
    ]
)
EXTRACTED_JSON = T.StructType([T.StructField("places", T.ArrayType(EXTRACTED_PLACE))])

STATIONS = T.StructType(
    [
        T.StructField(c, T.StringType())
        for c in ["country", "station_name", "description", "phone", "link"]
    ]
)
