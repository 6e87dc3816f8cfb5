"""Word lists, emoji sets, patterns, weights and category tables.

Entries that another entry of the same list implies are left out. Everything here must equal the published rules of the scoring scheme for results to
match, so it is stated as plain text and in one place. Patterns use only syntax that
means the same in Java regular expressions and in RE2, with the character classes
below spelled out to the Unicode meaning of white space, digits and word characters.
"""

from __future__ import annotations

# --- character classes (contents, to be used inside [...]) ---
SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
# the same white space as characters
SPACE_CHARS = "".join(map(chr, (
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)))
DIGIT = r"\p{Nd}"
WORD = r"\p{L}\p{N}_"
EMOJI = r"\x{1F300}-\x{1F9FF}"
UPPER = r"\p{Lu}\x{2160}-\x{216F}\x{24B6}-\x{24CF}\x{1F130}-\x{1F149}\x{1F150}-\x{1F169}\x{1F170}-\x{1F189}"
DIGIT_LIKE = (
    r"\p{Nd}\x{B2}\x{B3}\x{B9}\x{1369}-\x{1371}\x{19DA}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}"
    r"\x{2460}-\x{2468}\x{2474}-\x{247C}\x{2488}-\x{2490}\x{24EA}\x{24F5}-\x{24FD}\x{24FF}"
    r"\x{2776}-\x{277E}\x{2780}-\x{2788}\x{278A}-\x{2792}\x{1F100}-\x{1F10A}"
)

_S = f"[{SPACE}]*"
_D = f"[{DIGIT}]"

# --- production flags: any of these substrings in the lower-cased text ---
LOCATION = (
    "spot", "location", "place", "meet", "behind", "alley", "corner", "parking", "back",
    "private", "discrete", "usual", "secure", "safe", "quiet", "discreet",
)
LOCATION_RX = f"low{_S}key"
URGENCY = (
    "asap", "quick", "fast", "rush", "hurry", "now", "urgent", "immediate", "tonight",
    "limited time", "won't last", "last chance", "hit me up", "hmu", "dm me", "message me",
)
DISCRETION = (
    "quiet", "private", "secret", "discrete", "careful", "safe", "clean", "low key",
    "under radar", "no questions", "cash only", "no trace", "discreet", "confidential",
)
QUALITY = (
    "good", "pure", "clean", "best", "quality", "fire", "premium", "top", "grade a",
    "lab tested", "authentic", "genuine", "legit", "real",
)
TRANSACTION = (
    "have", "got", "available", "supply", "plug", "connect", "hook", "deal", "offer",
    "stock", "fresh batch", "just landed", "new arrival", "ready to go", "good to go",
)
PAYMENT = ("crypto", "btc", "bitcoin", "cash", "venmo", "paypal", "zelle", "no card", "no trace")
TIME = (
    "tonight", "tomorrow", "weekend", "friday", "saturday", "after hours", "late night",
    "midnight", "now", "asap", "immediate",
)
GREETING = (
    "hello", "hi", "hey", "how are you", "good morning", "good afternoon", "good evening",
    "thank you", "thanks", "please", "excuse me", "sorry", "goodbye", "bye", "see you",
    "take care", "have a good day",
)

# --- production patterns on numbers ---
PRICE_RX = (
    rf"\${_D}|{_D}{_S}(?:dollar|buck|each|apiece)|(?:price|cost)[^\n]*{_D}"
    rf"|{_D}{_S}(?:per|for){_S}(?:g|oz|ounce|lb|pound)"
)
QUANTITY_RX = rf"{_D}{_S}(?:g|oz|lb|k|piece|pack|bag|sheet|tab|pill)"

# --- production drug emojis; the last one lies outside the counted range ---
DRUG_EMOJIS = ("🍁", "💊", "💉", "🔥", "💨", "🌿", "🌱", "🍄", "🔌", "🪴")

# --- weights of the rule score ---
FLAG_WEIGHTS = {
    "has_drug_emoji": 4, "has_slang": 3, "has_price": 3, "has_quantity": 3, "has_location": 2,
    "has_urgency": 2, "has_discretion": 3, "has_quality": 2, "has_transaction": 3, "has_payment": 2,
}
COMBOS = {
    "suspicious_combo_1": ("has_drug_emoji", "has_price", 5),
    "suspicious_combo_2": ("has_drug_emoji", "has_quantity", 5),
    "suspicious_combo_3": ("has_slang", "has_location", 4),
    "suspicious_combo_4": ("has_price", "has_quantity", 4),
    "suspicious_combo_5": ("has_urgency", "has_discretion", 4),
    "suspicious_combo_6": ("has_drug_emoji", "has_slang", 4),
    "suspicious_combo_7": ("has_price", "has_location", 4),
}
MAX_SCORE = 57

# --- notebook extractor v1: substrings of the lower-cased text ---
V1_DRUG_EMOJIS = ("🍁", "💊", "💉", "🔥", "💨", "🌿", "🌱", "🍄", "🪴")
V1_URGENT_TIME = ("asap", "quick", "fast", "rush", "hurry", "now")
V1_LATE_HOURS = ("midnight", "late", "night", "after hours", "pm")
V1_LOCATION = ("spot", "location", "place", "meet", "behind", "alley")
V1_QUANTITY_RX = rf"{_D}{_S}(?:g|oz|ounce|lb|pound|k)"
V1_PRICE = ("price", "cost", "deal")
V1_PRICE_RX = rf"\${_D}|{_D}{_S}dollars"
V1_URGENCY = ("need", "want", "looking", "asap", "urgent", "today")
V1_DISCRETION = ("quiet", "private", "secret", "discrete", "careful", "safe")
V1_QUALITY = ("good", "pure", "clean", "best", "quality", "fire")
V1_TRANSACTION = ("have", "got", "available", "supply", "plug", "connect")

# --- notebook extractor v2: whole tokens ---
V2_MONEY_EMOJIS = ("💰", "💵", "💸", "🤑", "💲")
V2_TIME = ("asap", "quick", "fast", "rush", "hurry", "now", "tonight", "soon")
V2_TIME_PAIRS = ("right now", "real quick", "hit me", "hmu", "dm me")
V2_LOCATION = ("spot", "location", "place", "meet", "behind", "alley", "corner", "parking")
V2_DISCREET = ("back", "behind", "alley", "low", "key", "quiet", "private")
V2_SECURE_PLATFORMS = ("telegram", "signal", "wickr")
V2_URGENCY = ("need", "want", "looking", "asap", "urgent", "today", "quick", "fast")
V2_DISCRETION = ("quiet", "private", "secret", "discrete", "careful", "safe", "clean")
V2_QUALITY = ("good", "pure", "clean", "best", "quality", "fire", "premium", "top")
V2_TRANSACTION = ("have", "got", "available", "supply", "plug", "connect", "hook")
V2_TRUST = ("legit", "trusted", "reliable", "safe", "guaranteed", "genuine")
V2_EXCLUSIVE = ("limited", "exclusive", "special", "only", "few", "left")
V2_PRICE_RX = _D
V2_QUANTITY_RX = rf"{_D}{_S}(?:g|oz|ounce|lb|pound|k|piece|pack)"
V2_SPECIAL_CHARS = "@#$%*"

# --- lexicon extractor: case-insensitive substrings ---
LEX_CURRENCY_RX = rf"[$₹][{SPACE}]?{_D}+"
LEX_CONTACT = ("meet", "spot", "drop", "location", "pin", "dm", "pm")
LEX_AVAILABLE = ("got", "fresh batch", "in stock", "moving fast")
LEX_PAYMENT = ("crypto", "btc", "upi", "gpay", "paytm", "card")

# --- notebook extractor v3 ---
V3_DRUG_EMOJIS = ("💊", "🔌", "💉")
V3_MONEY_EMOJIS = ("💵", "📦", "💰")
_EDGE = f"(?:^|[^{WORD}])"
_END = f"(?:[^{WORD}]|$)"
# words that must occur for a pattern to match
V3_URGENT_TIME = ("asap", "urgent", "quick", "now")
V3_LATE = ("tonight", "later")
V3_LOCATION = ("spot", "place", "location", "corner", "back", "behind")
V3_QUANTITY = ("exactly", "precise", "pure", "clean")
V3_PRICE = ("price", "cost")
V3_URGENCY = ("limited", "only", "few", "last", "remaining", "won't last", "going fast")
V3_DISCRETION = ("private", "discrete", "secret", "secure", "safe", "trusted", "verified")
V3_QUALITY = ("premium", "pure", "clean", "tested", "lab", "authentic", "genuine", "real")
V3_TRANSACTION = ("deal", "offer", "discount", "bulk", "wholesale", "minimum", "sample")
V3_URGENT_TIME_RX = rf"(?:{'|'.join(V3_URGENT_TIME)}){_S}(?:{_D}|am|pm)"
V3_LATE_RX = (
    rf"{_EDGE}(?:2[0-3]|[1-9]|1[0-9])(?::{_D}{_D})?{_S}(?:pm|am)?{_S}(?:{'|'.join(V3_LATE)})"
)
V3_LOCATION_RX = rf"{_EDGE}(?:{'|'.join(V3_LOCATION)})[{SPACE}]+(?:usual|safe|private|quiet|discrete)"
V3_QUANTITY_RX = rf"{_EDGE}(?:{'|'.join(V3_QUANTITY)})[{SPACE}]+{_D}"
V3_PRICE_RX = rf"{_EDGE}(?:{'|'.join(V3_PRICE)}){_S}(?:neg|flexible|firm|fixed)"
V3_URGENCY_RX = rf"{_EDGE}(?:{'|'.join(V3_URGENCY)}){_END}"
V3_DISCRETION_RX = rf"{_EDGE}(?:{'|'.join(V3_DISCRETION)}){_END}"
V3_QUALITY_RX = rf"{_EDGE}(?:{'|'.join(V3_QUALITY)}){_END}"
V3_TRANSACTION_RX = rf"{_EDGE}(?:{'|'.join(V3_TRANSACTION)}){_END}"

# --- input checks ---
UNSAFE_RX = (
    rf"<script[^\n]*?>[^\n]*?</script>|javascript:|on[{WORD}]+{_S}=|eval{_S}\(|exec{_S}\("
)
BLANK_REASON = "Please enter a message to analyze."
LONG_REASON = "Message is too long. Please limit to 10,000 characters."
UNSAFE_REASON = "Input contains potentially unsafe content."

# --- recommended actions per band ---
ACTIONS = {
    "High": (
        "Review message context and sender",
        "Consider additional verification",
        "Flag for manual review",
    ),
    "Medium": ("Monitor conversation patterns", "Consider context and sender history"),
    "Low": (),
}

# --- generated negatives ---
NEGATIVE_PLATFORMS = ("Telegram", "Discord", "WhatsApp", "Reddit")
NEGATIVE_TEXTS = (
    "Hello how are you", "What time is the meeting", "See you tomorrow", "Can you call me later",
)

# --- slang lexicon: term by category ---
SLANG = {
    "marijuana": (
        "weed", "herb", "grass", "pot", "dope", "ganja", "bud", "chronic", "mary jane", "reefer",
        "skunk", "green", "loud", "fire", "gas", "nuggets", "nugs", "trees", "sticky", "kush",
        "og", "indoor", "outdoor", "hydro", "sativa", "indica", "hybrid", "edibles", "dabs", "wax",
        "shatter", "rosin", "hash", "thc", "cbd", "flower", "smoke", "joint", "blunt", "bowl",
        "pipe", "vape", "cart", "concentrate", "distillate", "live resin", "budder", "crumble",
        "sauce", "diamonds",
    ),
    "cocaine": (
        "coke", "blow", "snow", "white", "powder", "nose candy", "yayo", "charlie", "candy", "dust",
        "flake", "pearl", "rock", "sugar", "toot", "coca", "base", "crack", "hard", "stones",
        "cookies", "eight ball", "ball", "fishscale", "pure",
    ),
    "heroin": (
        "h", "smack", "junk", "horse", "china white", "black tar", "dragon", "brown", "mud", "boy",
        "skag", "thunder", "mexican brown", "big h", "hero", "beast", "chiva", "negra", "tar", "fent",
    ),
    "methamphetamine": (
        "meth", "crystal", "ice", "glass", "crank", "chalk", "blue", "tina", "crystal meth", "speed",
        "shards", "clear", "go fast", "zip", "blade",
    ),
    "mdma": (
        "molly", "x", "e", "rolls", "beans", "pills", "thizz", "mdma", "ecstasy", "candy",
        "skittles", "tesla", "superman", "love drug", "adam",
    ),
    "fentanyl": (
        "fenty", "china girl", "apache", "friend", "jackpot", "murder 8", "dance fever", "goodfella",
        "blues", "dragon", "white girl", "facebook", "freddy", "shoes", "poison",
    ),
    "prescription": (
        "xanax", "bars", "benzos", "footballs", "yellow buses", "oxy", "oxys", "percs", "vikes",
        "norcos", "tabs", "blues", "addys", "uppers", "study buddies", "smart pills", "focus",
        "ritalin", "adderall", "dilaudid",
    ),
    "general": (
        "plug", "connect", "dealer", "trap", "work", "product", "stuff", "package", "pack", "weight",
        "ounce", "o", "half", "quarter", "eighth", "gram", "g", "key", "brick", "block",
        "slab", "batch", "supply", "stash", "inventory", "menu", "fire sale", "special", "deal",
        "discount", "bulk", "wholesale", "retail", "sample", "tester", "quality", "grade", "strength",
        "potency", "purity",
    ),
}

# --- emoji lexicon: emoji by category ---
EMOJIS = {
    "universal": "🍁 💊 💉 🔥 💨 🌿 🍄 ⚡ 💎 🔌",
    "marijuana": "🌲 🌴 🍀 🚬 😮💨 💚 🟢 🌱 🍃 🌳 🥦 🥬 🧄 🫑 🟫 💚 🎄 🌵 🪴 🍈",
    "cocaine": "❄️ ⛄ 🌨️ 🏔️ 🤍 ⚪ 🔵 💠 🔷 💙 ⭐ ✨ 🌟 💫 ⚫ 🎱 🏳️ 🥥 🧊 ❇️",
    "heroin": "🤎 🟤 🐉 🐎 🎯 🍫 🍯 ☕ 🫘 🥜 🧸 💉 🩸 🔴 🟥 ❤️ 💔 🆘 ⛔ 🚫",
    "methamphetamine": "💙 🔮 🧊 🧪 💎 🔵 💠 🔷 🆔 🌀 ⚡ 🌊 🌐 ❄️ 🫧 💧 🏔️ 🔹 🔸 🚿",
    "mdma": "🍬 ❌ ⚡ 💊 ❤️ 💜 💖 💕 💘 😍 🎉 🎊 🌈 🦄 ✨ 🎭 🎪 🎨 🍭 🧚",
    "fentanyl": "🔵 💙 🟦 🫐 👮 ⚠️ ☠️ 💀 ⚡ 🩻 🚨 🆘 ❌ 🚫 ⛔ 🔴 🟥 💊 🧪 ☢️",
    "prescription": "💊 🚌 🍫 🟡 🟨 ⭐ 🔵 🚆 🍌 🅿️ 📘 🧠 ⏰ 📚 🎓 ✏️ 📝 💡 ⚖️ 🏥",
    "dealer": "📱 ⛽ 🪂 📦 🔌 💰 🤑 💵 💸 💳 🏚️ 🔑 🎯 👑 📍 📲 💬 🤝 🛒 🛍️",
    "quality": "💥 💣 🚀 🌟 ✨ ⭐ 🏆 🥇 👑 💎 🔥 🌶️ 🌋 ⚡ 💢 🎆 🎇 🌠 ☄️ 🔆",
    "quantity": "🍪 🧱 📦 🎒 👜 💼 🛍️ 📱 ⚖️ 🪙",
}

# --- English stop words (the classic Snowball list, words of two letters or more) ---
STOP_WORDS = tuple(
    "me my myself we our ours ourselves you your yours yourself yourselves he him his himself "
    "she her hers herself it its itself they them their theirs themselves what which who whom "
    "this that these those am is are was were be been being have has had having do does did "
    "doing an the and but if or because as until while of at by for with about against between "
    "into through during before after above below to from up down in out on off over under "
    "again further then once here there when where why how all any both each few more most "
    "other some such no nor not only own same so than too very can will just don should now".split()
)


def slang_rows() -> list[tuple[str, str]]:
    """The slang lexicon as (term, category) rows, duplicates kept."""
    return [(term, category) for category, terms in SLANG.items() for term in terms]


def emoji_rows() -> list[tuple[str, str]]:
    """The emoji lexicon as (emoji, category) rows, duplicates kept."""
    return [(emoji, category) for category, line in EMOJIS.items() for emoji in line.split()]


def slang_terms() -> tuple[str, ...]:
    return tuple(dict.fromkeys(term.lower() for term, _ in slang_rows()))


def emoji_terms() -> tuple[str, ...]:
    return tuple(dict.fromkeys(emoji for emoji, _ in emoji_rows()))
