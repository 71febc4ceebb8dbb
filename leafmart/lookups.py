"""Caps, targets, word lists and bands. Everything here is data, no logic."""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Highest acceptable sale price per category (tier in grams -> cap, or one flat cap).
# "base" holds for every market that is not listed.
# ---------------------------------------------------------------------------
PRICE_CAPS = {
    "base": {
        "flower": {3.5: 22, 7: 40, 14: 55, 28: 100},
        "vape": 25,
        "edible": 15,
        "concentrate": {0.5: 18, 1: 25, 2: 50},
        "preroll": 9,
        "infused_preroll": 15,
        "preroll_pack": 20,
    },
    "michigan": {
        "flower": {3.5: 15, 7: 28, 14: 45, 28: 80},
        "vape": 22,
        "edible": 12,
        "concentrate": {0.5: 20, 1: 35, 2: 60},
        "preroll": 7,
        "infused_preroll": 12,
        "preroll_pack": 20,
    },
    "new-jersey": {
        "flower": {3.5: 35, 7: 60, 14: 90, 28: 160},
        "vape": 40,
        "edible": 20,
        "concentrate": {0.5: 35, 1: 60, 2: 100},
        "preroll": 12,
        "infused_preroll": 20,
        "preroll_pack": 35,
    },
    "ohio": {
        "flower": {3.5: 30, 7: 55, 14: 80, 28: 140},
        "vape": 35,
        "edible": 18,
        "concentrate": {0.5: 30, 1: 55, 2: 90},
        "preroll": 11,
        "infused_preroll": 18,
        "preroll_pack": 30,
    },
    "missouri": {
        "flower": {3.5: 25, 7: 45, 14: 65, 28: 110},
        "vape": 30,
        "edible": 16,
        "concentrate": {0.5: 28, 1: 48, 2: 80},
        "preroll": 10,
        "infused_preroll": 16,
        "preroll_pack": 28,
    },
    "illinois": {
        "flower": {3.5: 30, 7: 55, 14: 80, 28: 140},
        "vape": 35,
        "edible": 18,
        "concentrate": {0.5: 30, 1: 55, 2: 90},
        "preroll": 11,
        "infused_preroll": 18,
        "preroll_pack": 30,
    },
    "arizona": {
        "flower": {3.5: 25, 7: 45, 14: 65, 28: 110},
        "vape": 30,
        "edible": 16,
        "concentrate": {0.5: 28, 1: 48, 2: 80},
        "preroll": 10,
        "infused_preroll": 16,
        "preroll_pack": 28,
    },
    "colorado": {
        "flower": {3.5: 18, 7: 32, 14: 50, 28: 90},
        "vape": 25,
        "edible": 14,
        "concentrate": {0.5: 22, 1: 40, 2: 65},
        "preroll": 8,
        "infused_preroll": 14,
        "preroll_pack": 22,
    },
    "massachusetts": {
        "flower": {3.5: 32, 7: 58, 14: 85, 28: 150},
        "vape": 38,
        "edible": 18,
        "concentrate": {0.5: 32, 1: 58, 2: 95},
        "preroll": 12,
        "infused_preroll": 18,
        "preroll_pack": 32,
    },
    "northern-nv": {
        "flower": {3.5: 20, 7: 38, 14: 52, 28: 95},
        "vape": 23,
        "edible": 12,
        "concentrate": {0.5: 17, 1: 23, 2: 47},
        "preroll": 9,
        "infused_preroll": 14,
        "preroll_pack": 19,
    },
}
UNCAPPED_CATEGORY_CAP = 50
LOOSE_PLATFORMS = ["jane", "carrot", "aiq"]
LOOSE_CAP_MULTIPLIER = 1.3

# Global offer limits.
MIN_PRICE = 3
MAX_PRICE = 100
MIN_DISCOUNT = 15
MAX_DISCOUNT = 85
CATEGORY_MIN_DISCOUNT = {"edible": 12, "preroll": 12}
ORIGINAL_CEILINGS = {"flower": 100, "vape": 80, "edible": 50, "concentrate": 100, "preroll": 30}
PACK_ORIGINAL_CEILING = 50
# Vape limits per subtype as (up to 0.6 g, above 0.6 g).
VAPE_FLOORS = {"disposable": (8, 17), "cartridge": (7, 14), "pod": (7, 14)}
VAPE_CAPS = {"disposable": (25, 35), "cartridge": (25, 35), "pod": (25, 35)}

# Words that mark a listing as merchandise (matched anywhere in name or raw text).
MERCH_WORDS = [
    "apparel", "clothing", "shirt", "t-shirt", "tshirt", "hoodie",
    "hat", "cap", "beanie", "socks", "merch", "merchandise",
    "accessory", "accessories", "grinder", "lighter", "tray",
    "rolling paper", "pipe", "bong", "stash", "bag", "backpack",
    "lanyard", "keychain", "pin", "sticker", "poster",
    "gift card", "gift certificate", "vape battery", "pen battery",
]

# Labels that are not product names.
LABEL_ONLY_NAMES = [
    "indica", "sativa", "hybrid", "cbd", "thc", "unknown",
    "flower", "vape", "edible", "concentrate", "preroll", "pre-roll",
    "cartridge", "cart", "badder", "shatter", "wax", "gummy", "gummies",
]
WEIGHT_REQUIRED = ["flower", "concentrate", "vape"]
MIN_EDIBLE_MG = 50
PROMO_NAME_PATTERN = (
    r"\b\d+\s+for\s+\$\d+|\b\d+\s*/\s*\$\d+|\bbuy\s+\d+\s+get\b|\bbogo\b"
    r"|\bmix\s*(?:and|&|n)\s*match\b|\bbundle\b"
)
# Patterns of sale copy in a listing name.
SALE_COPY_PATTERNS = [
    r"^\d+%\s*off", r"^\$\d+\.?\d*\s*off", r"^buy\s+\d+\s+get", r"^bogo", r"^sale\b", r"^special\b",
    r"^deal\s+of", r"^daily\s+deal", r"^clearance\b", r"^mix\s*(?:and|&|n)\s*match", r"^bundle\b", r"^promo\b",
    r"\|\s*\d+%\s*off", r"off\s+(?:all|select|any)\s", r"\b\d+\s+for\s+\$\d+", r"\b\d+\s*/\s*\$\d+",
    r"\bbuy\s+\d+\s+get\b",
]

# ---------------------------------------------------------------------------
# Score parts.
# ---------------------------------------------------------------------------
DISCOUNT_POINTS = [(50, 35), (40, 28), (30, 22), (25, 17), (20, 12), (15, 7)]
LOOSE_PLATFORM_POINTS = 15
BRAND_POINTS = {"premium": 20, "popular": 12, "other": 5}
CATEGORY_POINTS = {"flower": 8, "vape": 8, "edible": 8, "concentrate": 7, "preroll": 7}
OTHER_CATEGORY_POINTS = 3
BADGES = [("steal", 85), ("fire", 70), ("solid", 50)]
# Brand tiers, by market.
BRAND_TIERS = {
    "premium": [
        "stiiizy", "cookies", "raw garden", "kiva", "wyld",
        "connected", "alien labs", "jungle boys", "cannabiotix", "cbx",
        "jeeter", "packwoods", "runtz",
    ],
    "popular": [
        "rove", "select", "heavy hitters", "trendi", "camp",
        "old pal", "pacific stone", "fleur", "virtue",
        "curaleaf", "matrix", "kynd", "city trees",
        "camino", "airopro", "bounti", "smokiez",
        "dixie", "sip", "mpx", "sublime",
        "wana", "incredibles", "verano", "grassroots",
        "rythm", "plug play", "pax", "kingpen",
        "doja", "wonderbrett", "ember valley", "backpack boyz",
        # Michigan
        "platinum vape", "mkx", "lume", "skymint",
        "element", "redbud roots", "pleasantrees",
        "joyology", "pinnacle emporium", "herbana",
        "exclusive cannabis", "high profile", "five star extracts",
        "humblebee", "redemption", "drip", "viola",
        "house of dank", "hod", "church cannabis",
        "choice edibles", "detroit edibles", "nirvana center",
        # Illinois
        "revolution", "aeriz", "bedford grow", "cresco",
        "high supply", "good news", "matter", "superflux",
        "thrive", "essence", "cake", "&shine",
        "pts", "nature's grace", "encore edibles",
        "savvy", "reserve",
        # Arizona
        "abundant organics", "grow sciences", "item 9 labs",
        "timeless", "sonoran roots", "mohave cannabis",
        # Missouri
        "illicit", "flora farms", "vivid", "sinse",
        "proper", "clovr", "good day farm", "headchange",
        "elevate", "greenlight", "haze", "nature med",
        "vertical", "star buds", "bloc", "terrabis",
        "c4", "amaze cannabis", "keef", "robhots",
        "swade", "fresh green", "n'bliss", "from the earth",
        "old route 66", "heya", "solhaus", "cloud nine",
        "heartland labs", "robust",
        # New Jersey
        "kind tree", "fernway", "ozone", "rythm",
        "garden greens", "the botanist", "clade9",
        "terrascend", "good green", "later days",
        "grön", "gron", "jams", "beboe", "avexia",
        "level", "bits",
        "breakwater", "garden state canna", "the heirloom collective",
        "harmony", "apothecarium", "purple leaf", "bloc nj",
        # Ohio
        "klutch", "klutch cannabis", "buckeye relief", "firelands scientific",
        "standard wellness", "galenas", "ancient roots",
        "ohio clean leaf", "pure ohio wellness", "the botanist oh",
        "body and mind", "terrasana", "about wellness",
        "bloom oh", "amplify", "ohio provisions",
        "butterfly effect", "grow ohio", "columbia care oh",
        "have a heart", "the forest",
        # Colorado
        "green dot labs", "olio", "lazercat", "viola co",
        "native roots", "the green solution", "livwell",
        "standing akimbo", "terrapin care station", "l'eagle",
        "silver stem", "medicine man", "lightshade",
        "the dab", "bonsai cultivation",
        # Massachusetts
        "theory wellness", "commcan", "neta", "curaleaf ma",
        "good chemistry", "mayflower", "berkshire roots",
        "happy valley", "fernway", "harbor house collective",
        "panacea", "bask", "temescal wellness",
        # Northern Nevada
        "sierra well", "mynt cannabis", "kanna",
        "blüm", "blum", "greenleaf wellness",
        # house brands of Nevada stores
        "deep roots", "deep roots harvest",
        "state flower", "cultivation labs",
        "the sanctuary",
    ],
}

# ---------------------------------------------------------------------------
# Selection of the daily top list.
# ---------------------------------------------------------------------------
TARGET_DEALS = 300
CATEGORY_TARGETS = {
    "flower": 85, "vape": 30, "disposable": 45, "edible": 43, "concentrate": 43, "preroll": 36, "other": 18,
}
CATEGORY_MINIMUMS = {
    "flower": 20, "vape": 10, "disposable": 25, "edible": 15, "concentrate": 10, "preroll": 10, "other": 0,
}
BRAND_CAP, BRAND_CATEGORY_CAP, STORE_CAP = 7, 4, 18
BACKFILL_BRAND_CAP, BACKFILL_BRAND_CATEGORY_CAP, BACKFILL_STORE_CAP = 12, 8, 24
BACKFILL_THRESHOLD = 0.85
STORE_MINIMUM = 2
DISPOSABLES_PER_CHAIN = 6
DEALS_PER_CHAIN = 24
MAX_SIMILAR_PER_STORE = 3
ANCHOR_STORES = ["td-gibson", "td-eastern", "td-decatur", "oasis"]
STORE_FLOORS = [(200, 5), (100, 4), (50, 3), (10, 2), (0, 1)]
GUARANTEE_SCORE_CAP = 25
MULTI_WORD_CHAIN_HEADS = ["the", "nevada", "deep", "beyond", "tree"]
BLOCKED_STORE_PREFIXES = ["zen-leaf"]

# Weight tiers per category as inclusive bands.
WEIGHT_BANDS = {
    "flower": [(0.5, 2.0, "1g"), (2.5, 4.5, "3.5g"), (5.0, 10.0, "7g"), (10.5, 16.0, "14g"), (16.5, 32.0, "28g")],
    "vape": [(0.1, 0.4, "0.3g"), (0.4, 0.6, "0.5g"), (0.8, 1.2, "1g")],
    "concentrate": [(0.4, 0.6, "0.5g"), (0.8, 1.2, "1g"), (1.5, 2.5, "2g")],
    "edible": [(50, 120, "100mg"), (150, 250, "200mg")],
    "preroll": [(0.5, 1.5, "1g")],
}

# Event names.
SAVE_EVENTS = ["deal_saved", "deal_save"]
CLICK_EVENTS = ["get_deal_click"]
ENGAGED_EVENTS = ["deal_view", "deal_viewed", "deal_modal_open", "deal_click"]
ACTIVATED_EVENTS = SAVE_EVENTS + CLICK_EVENTS
SHARE_EVENTS = ["deal_shared", "share_saves"]

# Accepted values per checked column.
CATEGORIES = ["flower", "preroll", "vape", "edible", "concentrate", "other"]
WEIGHT_UNITS = ["g", "mg", "oz"]
STRAINS = ["Indica", "Sativa", "Hybrid"]
PLATFORMS = ["dutchie", "curaleaf", "jane", "carrot", "aiq", "rise", "pending"]
REGIONS = [
    "southern-nv", "northern-nv", "michigan", "illinois", "arizona", "missouri", "new-jersey", "ohio", "colorado",
    "new-york", "massachusetts", "pennsylvania",
]
SHARDED_REGIONS = [
    "southern-nv", "michigan", "illinois", "colorado", "massachusetts", "new-jersey", "arizona", "missouri", "ohio",
    "new-york", "pennsylvania",
]
RUN_STATUSES = ["running", "completed", "completed_with_errors", "failed"]
FINISHED_STATUSES = ["completed", "completed_with_errors"]
REPORT_TYPES = ["wrong_price", "deal_gone", "wrong_product", "other"]
CONCENTRATE_SUBTYPES = [
    "live_resin", "cured_resin", "budder", "badder", "shatter", "diamonds", "sauce", "rosin", "hash_rosin",
    "live_rosin", "crumble", "wax", "sugar", "rso", "fsho",
]
EDIBLE_SUBTYPES = ["gummy", "chocolate", "beverage", "tincture", "capsule", "lozenge", "baked_good", "chew"]
SUBTYPES = ["infused_preroll", "preroll_pack", "disposable", "cartridge", "pod"] + CONCENTRATE_SUBTYPES + EDIBLE_SUBTYPES

# Search result junk, distance labels (miles), Earth radii (miles).
SEARCH_JUNK_PATTERN = (
    r"\b(?:battery|batteries|grinder|lighter|rolling\s+papers?|tray|stash|pipe|bong|rig|torch|scale|jar|container"
    r"|apparel|shirt|hat|merch)\b"
)
DISTANCE_LABELS = [(5, "Near You"), (10, "Nearby"), (15, "Across Town")]
EARTH_RADIUS_HAVERSINE = 3958.8
EARTH_RADIUS_COSINE = 3959.0

# First three ZIP digits to state as inclusive ranges.
ZIP3_RANGES = [
    (5, 5, "NY"), (10, 27, "MA"), (28, 29, "RI"), (30, 38, "NH"), (39, 49, "ME"), (50, 54, "VT"), (55, 55, "NY"),
    (56, 59, "VT"), (60, 69, "CT"), (70, 89, "NJ"), (100, 149, "NY"), (150, 196, "PA"), (197, 199, "DE"),
    (200, 200, "DC"), (201, 201, "VA"), (202, 205, "DC"), (206, 212, "MD"), (214, 219, "MD"), (220, 246, "VA"),
    (247, 268, "WV"), (270, 289, "NC"), (290, 299, "SC"), (300, 319, "GA"), (320, 342, "FL"), (344, 344, "FL"),
    (346, 347, "FL"), (349, 349, "FL"), (350, 352, "AL"), (354, 369, "AL"), (370, 385, "TN"), (386, 397, "MS"),
    (398, 399, "GA"), (400, 418, "KY"), (430, 458, "OH"), (460, 479, "IN"), (480, 499, "MI"), (500, 516, "IA"),
    (520, 528, "IA"), (530, 532, "WI"), (534, 535, "WI"), (537, 549, "WI"), (550, 551, "MN"), (553, 567, "MN"),
    (570, 577, "SD"), (580, 588, "ND"), (590, 599, "MT"), (600, 620, "IL"), (622, 629, "IL"), (630, 631, "MO"),
    (633, 641, "MO"), (644, 658, "MO"), (660, 662, "KS"), (664, 679, "KS"), (680, 681, "NE"), (683, 693, "NE"),
    (700, 701, "LA"), (703, 708, "LA"), (710, 714, "LA"), (716, 729, "AR"), (730, 731, "OK"), (733, 733, "TX"),
    (734, 741, "OK"), (743, 749, "OK"), (750, 799, "TX"), (800, 816, "CO"), (820, 831, "WY"), (832, 838, "ID"),
    (840, 847, "UT"), (850, 853, "AZ"), (855, 857, "AZ"), (859, 860, "AZ"), (863, 865, "AZ"), (870, 875, "NM"),
    (877, 884, "NM"), (889, 891, "NV"), (893, 898, "NV"), (900, 908, "CA"), (910, 928, "CA"), (930, 961, "CA"),
    (967, 968, "HI"), (970, 979, "OR"), (980, 986, "WA"), (988, 994, "WA"), (995, 999, "AK"),
]
RECREATIONAL_STATES = [
    "AK", "AZ", "CA", "CO", "CT", "DE", "IL", "MA", "MD", "ME", "MI", "MN", "MO", "MT", "NJ", "NM", "NV", "NY", "OH",
    "OR", "RI", "VA", "VT", "WA", "DC",
]
MEDICAL_STATES = ["AL", "AR", "FL", "HI", "KY", "LA", "MS", "NH", "ND", "OK", "PA", "SD", "UT", "WV"]
