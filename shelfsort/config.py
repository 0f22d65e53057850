"""Thresholds, rule lists and schemas.

Everything a user may want to change is a parameter of ``TagConfig``; the
defaults below reproduce the behaviour of the system this engine replaces.
"""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

from .operators.boosting import BoostParams

# ---------------------------------------------------------------------------
# FIXED VALUES — these must stay equal to the original system's values for
# the results to match.  Listed plainly, in their original order.
# ---------------------------------------------------------------------------

# Keyword rules: (pattern, category).  Tried in this order; the first pattern
# found anywhere in the name wins.  Patterns are matched case-insensitively
# with Unicode word boundaries.
KEYWORD_RULES: tuple[tuple[str, str], ...] = (
    (r"\b(non.?alcohol|alcohol.?free|0\.0%|0%\s*abv|sunbrew)\b", "Non-alcoholic Beer"),
    (r"\b(hard\s+seltzer|hard\s+selt|hard\s+lem|hard\s+tea|hard\s+cider|hard\s+kombucha|hard\s+ginger|malt\s+bev|rtd|ready.to.drink|spiked)\b", "Hard Beverage"),
    (r"\b(lager|ale|ipa|stout|porter|pilsner|pilsener|bock|saison|cerveza|beer|weiss|weizen|hefe|cider(?!\s+vin))\b", "Beer"),
    (r"\b(wine|chardonnay|merlot|cabernet|sauvignon|pinot|riesling|ros[eé]|prosecco|champagne|sparkling\s+wine|shiraz|malbec|zinfandel)\b", "Wine"),
    (r"\b(vodka|whisky|whiskey|bourbon|scotch|rum|tequila|gin|brandy|cognac|liqueur|mezcal|absinthe|schnapps|triple\s+sec|vermouth)\b", "Spirits"),
    (r"\b(water|juice|soda|cola|coffee|tea(?!\s+hard)|energy\s+drink|sports\s+drink|lemonade|kombucha(?!\s+hard)|smoothie|shake|protein|vitamin)\b", "Non-alcoholic Beverage"),
)

# Packaging / size / descriptor words removed before the similarity layers.
NOISE_PATTERN: str = (
    r"\b(\d+\s*(x|pk|pack|ml|cl|l|oz|fl\.?\s*oz|can|cans|bottle|bottles|"
    r"longneck|tallboy|stubby|keg|case|litre|liter|pint|quart)|"
    r"premium|select|special|reserve|vintage|"
    r"limited|edition|fresh|natural|organic|"
    r"imported|import|domestic|draft|draught)\b"
)

# Sub-category keyword layer: words that never count as a candidate word.
SUB_SKIP_WORDS: tuple[str, ...] = (
    "beer", "ale", "pack", "packs", "cans", "bottles", "that", "from", "with", "fl", "oz",
)

# Sub-category keyword layer: name words that imply a sub-category.
STYLE_ALIASES: dict[str, tuple[str, ...]] = {
    "Craft Beer": (
        "ipa", "stout", "porter", "hazy", "saison", "sour", "pale",
        "hefeweizen", "weiss", "weizen", "amber", "bock", "barleywine",
        "session", "wheat", "kolsch", "tripel", "dubbel", "pilsner", "pilsener",
    ),
    "Light Lager": ("light", "lite"),
    "Classic Lager": ("lager", "cerveza"),
    "Hard Seltzers": ("seltzer", "seltzers"),
    "Cider": ("cider",),
    "Ready to Drink": ("rtd",),
    "Flavored Hard Beverages": ("cocktail", "punch", "lemonade"),
}

# Sub-category fuzzy layer: generic words removed from both sides.
GENERIC_WORDS_PATTERN: str = r"\b(beer|ale|brew|brewing|brewed)\b"

# Source priority when the label table is saved (lower wins).
SAVE_PRIORITY: dict[str, int] = {
    "human": 0, "seed": 1, "llm": 2, "batch_cache": 3, "vector": 4,
    "fuzzy": 5, "ml": 6, "keyword": 7,
}
SAVE_PRIORITY_OTHER = 8

# Source priority when training data / lookup keys are derived.
TRAIN_PRIORITY: dict[str, int] = {"human": 0, "seed": 1, "llm": 2, "ml": 3}
TRAIN_PRIORITY_OTHER = 3

AUTHORITATIVE_SOURCES: tuple[str, ...] = ("seed", "human")
RELIABLE_SOURCES: tuple[str, ...] = ("seed", "human", "keyword")
MACHINE_SOURCES: tuple[str, ...] = ("ml", "llm", "vector", "fuzzy")
REVIEW_SOURCES: tuple[str, ...] = ("llm", "fallback", "batch_cache")

# Built-in seed records: (sub_category, category).
DEFAULT_SEEDS: tuple[tuple[str, str], ...] = (
    ("Craft Beer", "Beer"),
    ("Variety Packs", "Beer"),
    ("Classic Lager", "Beer"),
    ("Light Lager", "Beer"),
    ("Cider", "Hard Beverage"),
    ("Hard Seltzers", "Hard Beverage"),
    ("Ready to Drink", "Hard Beverage"),
    ("Flavored Hard Beverages", "Hard Beverage"),
    ("Non-alcoholic Beer", "Non-alcoholic Beer"),
)

# Prompt texts for the outside reviewer / language model.
CATEGORY_SYSTEM_PROMPT: str = (
    "You are a product categorization expert.\n"
    "Given a product name, assign it to exactly ONE of the provided client categories.\n"
    "\n"
    "Rules:\n"
    '- Return ONLY valid JSON: {"category": "<chosen category>", "confidence": <0.0-1.0>}\n'
    '- "category" must be one of the listed categories – do not invent new ones\n'
    '- "confidence" is your certainty (0.0 = guessing, 1.0 = certain)\n'
    "- If none fits at all, pick the closest one and set confidence below 0.5\n"
)
CATEGORY_USER_PROMPT: str = (
    "Available categories:\n{categories}\n\n"
    'Product name: "{name}"\n\n'
    "Return JSON only."
)
MODEL_HINT_LINE: str = "\n(ML model hinted: '{category}', but with low confidence)"
SUB_USER_PROMPT: str = (
    'Product: "{name}"\n'
    "Category: {category}\n\n"
    "Known sub-categories:\n{candidates}\n\n"
    "Pick the BEST matching sub-category from the list above.\n"
    'Return ONLY JSON: {"sub_category": "<exact name from list>"}'
)
SUB_SYSTEM_PROMPT: str = "You are a product categorisation expert. Return only valid JSON."
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class TagConfig:
    """Decision thresholds and switches."""

    ml_threshold: float = 0.75
    fuzzy_threshold: float = 85.0          # token-sort ratio, 0..100
    vector_threshold: float = 0.80         # cosine
    vector_top_k: int = 5
    retrain_min_samples: int = 20
    sub_threshold: float = 0.55
    batch_cache_threshold: float = 92.0    # token-sort ratio, 0..100
    review_category_threshold: float = 0.75
    review_sub_threshold: float = 0.50
    keyword_confidence: float = 0.90
    sub_keyword_confidence: float = 0.92
    sub_llm_confidence: float = 0.80
    index_max_features: int = 20_000
    model_max_features: int = 10_000
    model_c: float = 5.0
    model_max_iter: int = 1000
    classifier: str = "linear"             # "linear" or "boosted"
    boost: BoostParams = BoostParams()     # shape of the boosted trees
    keyword_rules: tuple = KEYWORD_RULES
    style_aliases: dict = field(default_factory=lambda: dict(STYLE_ALIASES))
    # Largest table (rows) that may be broadcast; larger sides are shuffled.
    broadcast_max_rows: int = 1_000_000
    use_fuzzy: bool = True
    use_vector: bool = True
    use_ml: bool = True


# ---------------------------------------------------------------------------
# Schemas
# ---------------------------------------------------------------------------

LABEL_SCHEMA = T.StructType([
    T.StructField("product_name", T.StringType()),
    T.StructField("predicted_sub_category", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("sub_confidence", T.DoubleType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("corrected", T.BooleanType()),
    T.StructField("seq", T.LongType()),
])
LABEL_COLUMNS = [f.name for f in LABEL_SCHEMA.fields]

SEED_SCHEMA = T.StructType([
    T.StructField("sub_category", T.StringType()),
    T.StructField("category", T.StringType()),
])

RESULT_COLUMNS = [
    "row_id", "sub_category", "category", "confidence", "source",
    "predicted_sub_category", "sub_confidence", "sub_source",
    "low_confidence", "steps_tried",
]

BATCH_OUTPUT_COLUMNS = [
    "predicted_category", "predicted_sub_category", "category_confidence",
    "sub_category_confidence", "category_source", "sub_category_source",
    "needs_review",
]
