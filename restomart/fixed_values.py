"""Vocabularies, lookup tables, patterns and formats the results depend on."""

# Vocabularies of the silver tables.
SOURCES = ["toast", "doordash", "square"]
CHANNELS = ["pos", "online", "delivery_app", "third_party"]
ORDER_TYPES = ["dine_in", "takeout", "pickup", "delivery"]
PAYMENT_TYPES = ["credit", "cash", "wallet", "platform", "other"]
ORDER_STATUSES = ["completed", "delivered", "picked_up", "cancelled", "refunded"]
CARD_BRANDS = ["visa", "mastercard", "amex", "discover", "apple_pay", "google_pay"]
VARIATION_TYPES = ["quantity", "size", "serving", "strength", "semantic"]
MESSAGE_ROLES = ["user", "assistant"]
COMPLETED_STATUSES = ["completed", "delivered", "picked_up"]
TAKEOUT_TYPES = ["takeout", "pickup"]
DEFAULT_TIMEZONE = "America/New_York"

# Source code -> silver code. Codes not listed are lower-cased.
TOAST_ORDER_TYPES = {"DINE_IN": "dine_in", "TAKE_OUT": "takeout", "DELIVERY": "delivery"}
TOAST_CHANNELS = {"POS": "pos", "ONLINE": "online", "THIRD_PARTY": "third_party"}
DOORDASH_ORDER_TYPES = {"MERCHANT_DELIVERY": "delivery", "PICKUP": "pickup"}
SQUARE_ORDER_TYPES = {"DINE_IN": "dine_in", "PICKUP": "pickup", "DELIVERY": "delivery"}
PAYMENT_TYPE_CODES = {
    "CREDIT": "credit", "CARD": "credit", "CASH": "cash", "WALLET": "wallet", "OTHER": "other",
}
CARD_BRAND_CODES = {
    "VISA": "visa", "MASTERCARD": "mastercard", "AMEX": "amex", "AMERICAN_EXPRESS": "amex",
    "DISCOVER": "discover", "APPLE_PAY": "apple_pay", "GOOGLE_PAY": "google_pay",
}

# Abbreviations of standalone sizes and the maps used by label formats.
SIZE_ABBREVIATIONS = {"lg": "Large", "sm": "Small", "med": "Medium", "xl": "XL", "xxl": "XXL"}
SIZE_EXPAND = {"lg": "Large", "sm": "Small", "med": "Medium"}
STRENGTH_EXPAND = {"single": "Single", "double": "Double", "dbl": "Double"}

# Code-point ranges dropped from category names.
EMOJI_RANGES = [(0x1F300, 0x1F9FF), (0x2600, 0x26FF), (0x2700, 0x27BF)]

# Distances. Product names and groups, ratio rule, variation labels.
PRODUCT_DISTANCE = 3
RATIO_SHARE = 0.25
RATIO_DISTANCE = 5
LABEL_DISTANCE = 2

# Default configuration (overridden by configuration files).
DEFAULT_PATTERNS = [
    {"name": "quantity_suffix", "regex": r"\s*(\d+)\s*(pcs?|pieces?)\s*$", "flags": "i",
     "type": "quantity", "format": "{1} pcs"},
    {"name": "size_suffix_with_separator", "regex": r"\s*-\s*(small|medium|large|xl|xxl)\s*$",
     "flags": "i", "type": "size", "format": "{1|capitalize}"},
    {"name": "size_suffix", "regex": r"\s+(small|medium|large|xl|xxl)\s*$", "flags": "i",
     "type": "size", "format": "{1|capitalize}"},
    {"name": "size_prefix", "regex": r"^(lg|sm|med)\s+", "flags": "i", "type": "size",
     "format": "{1|size_expand}"},
    {"name": "serving_suffix", "regex": r"\s+(slice|whole pie|pint|glass|bottle)\s*$",
     "flags": "i", "type": "serving", "format": "{1|capitalize}"},
    {"name": "strength_suffix", "regex": r"\s+(single|double|dbl)\s*(shot)?\s*$", "flags": "i",
     "type": "strength", "format": "{1|strength_expand}"},
]
DEFAULT_ABBREVIATIONS = {
    "coke": "coca-cola", "oj": "orange juice", "fries": "french fries",
    "blt": "bacon lettuce tomato sandwich", "pb&j": "peanut butter and jelly sandwich",
    "chx": "chicken", "chkn": "chicken", "veg": "vegetable", "veggies": "vegetables",
}
DEFAULT_GROUPS = [
    {"base_name": "Wings", "suffix": "Wings"},
    {"base_name": "Fries", "suffix": "Fries"},
    {"base_name": "Pizza", "suffix": "Pizza"},
    {"base_name": "Salad", "suffix": "Salad"},
    {"base_name": "Wrap", "suffix": "Wrap"},
    {"base_name": "Milkshake", "suffix": "Milkshake"},
    {"base_name": "Nachos", "suffix": "Nachos"},
    {"base_name": "Wine", "suffix": "Wine"},
    {"base_name": "Fruit", "suffix": "Fruit"},
    {"base_name": "Burger", "suffix": "Burger"},
    {"base_name": "Coffee", "suffix": "Coffee", "keywords": ["espresso", "cold brew"]},
    {"base_name": "Soft Drink",
     "keywords": ["coca-cola", "coke", "fountain soda", "soft drink", "soda"]},
    {"base_name": "Steak", "keywords": ["ribeye steak", "filet mignon", "prime rib", "steak"]},
    {"base_name": "Sandwich", "suffix": "Sandwich", "keywords": ["turkey club"]},
    {"base_name": "Pasta", "suffix": "Pasta",
     "keywords": ["alfredo", "mac & cheese", "mac and cheese", "scampi"]},
]
PATTERN_TYPES = ["quantity", "size", "serving", "strength"]

# Category names that count as beverages.
BEVERAGE_PATTERN = "drink|beverage|beer|wine|cocktail|coffee|tea|juice|soda"

# Column names that mark a time axis.
TIME_AXIS_NAMES = ["hour", "day", "month", "year", "week"]
TIME_AXIS_PARTS = ["date", "time", "day", "hour", "month", "week"]
CHART_TYPES = ["bar", "line", "area", "pie", "radar", "radial", "table", "none"]

# Words a read-only statement must not hold.
WRITE_KEYWORDS = ["INSERT", "UPDATE", "DELETE", "DROP", "ALTER", "TRUNCATE", "CREATE"]

# Dollars per million tokens (model, input, cached input, output).
MODEL_PRICES = [
    ("grok-4.1-fast", 0.2, 0.05, 0.5),
    ("gpt-5.2", 1.75, 0.175, 14.0),
    ("gpt-oss-20b", 0.075, 0.075, 0.3),
]
