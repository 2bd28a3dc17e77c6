"""Patterns and weights of the text detectors. All fixed values: results depend on every one of them."""

from __future__ import annotations

# fixed values: limited stock
UNIT = "(?:rooms?|tickets?|seats?|items?|units?|pieces?|spots?|places?|nights?|copies|copy|boxes|packs?|bottles?|sets?)"
STOCK_NUMERIC = (
    rf"\bonly (\d{{1,3}}) (?:{UNIT} )?(?:left|remaining|available)\b",
    rf"\b(\d{{1,3}}) {UNIT} (?:left|remaining|available)\b",
    r"\b(\d{1,3}) (?:left|remaining) in stock\b",
    r"\bonly (\d{1,3}) in stock\b",
    r"\b(\d{1,3}) items? left\b",
)
STOCK_WORDS = (
    r"\bwhile (?:stocks?|supplies) last\b",
    r"\bwhile they last\b",
    r"\b(?:fill(?:s|ing)? up|selling out|going) fast\b",
    r"\bspaces?\s+(?:is |are )?limited\b|\blimited\s+spaces?\b",
    r"\bback in stock soon\b",
    r"\bbefore (?:these |they |it )?(?:items? )?(?:are |is )?(?:sold ?out|gone)\b",
    r"\ba limited (?:number|quantity|amount)\b",
    r"\blimited (?:quantity|quantities|availability|stock|supply)\b",
    r"\blow stock\b",
    r"\balmost (?:gone|sold out)\b",
    r"\bselling fast\b",
    r"\bhurry,? only\b",
    r"\blast (?:few |remaining )?(?:tickets?|seats?|rooms?|spots?|pairs?|units?|pieces?)\b",
)
STOCK_VARIANTS = (
    r"\b\d{1,3} (?:sizes?|colou?rs?|styles?|variants?|options?|shades?|widths?|lengths?) (?:left|remaining|available)\b",
    r"\b(?:size|colou?r|style) .{0,20}(?:out of stock|unavailable|sold out)\b",
)
STOCK_NOTICE = r"\balerts\b|\bnotifications?\b|\breminders?\b|\bget notified\b|\b(?:notify|remind|email|text) (?:me|you)\b"
STOCK_DISCLAIMER = r"\b(?:exclusions?|restrictions?|terms|conditions)\b[^.]{0,30}\bapply\b|\bterms (?:and|&) conditions\b"
STOCK_WEIGHTS = {"numeric": 0.75, "qualitative": 0.65, "progress": 0.15, "short": 0.1, "boilerplate": -0.2}

# fixed values: deadlines
DEADLINE = (
    r"\b(?:sale|offer|deal|discount|promo(?:tion)?|price|event|coupon)\b[^.:;!?|•]{0,24}?\b(?:ends?|ending|expires?|expiring|closes?|runs (?:through|thru|until|till|\d))\b",
    r"\b(?:ends?|ending|expires?|expiring)\s+(?:soon|today|tonight|tomorrow|shortly|in\b|on\b|\d)",
    r"\b(?:thru|through)\s+(?:\d{1,2}[/.]\d{1,2}\b|(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s*\d{1,2}\b|(?:mon|tues|wednes|thurs|fri|satur|sun)day\b|tonight\b|midnight\b)",
    r"\b(?:book|buy|order|shop)\s+by\s+(?:\d|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)",
    r"\blimited[-\s]time\b",
    r"\b\d+\s+days?\s+left\b",
    r"\blast (?:chance|day|call|hours?)\b",
    r"\b(?:today|tonight) only\b",
    r"\bhurry\b",
    r"\bprices?\s+(?:go(?:es)? up|increases?|rises?)\s+(?:after|on|at)\b",
)
DEADLINE_SPECIFIC = (
    r"\b(?:mon|tues|wednes|thurs|fri|satur|sun)day\b|\b(?:mon|tue|wed|thu|fri|sat|sun)\.?,?\s+\d{1,2}\b|\b\d{1,2}\/\d{1,2}\b|\b\d{1,2}(?::\d{2})?\s*(?:am|pm)\b"
    r"|\bin \d+ (?:hours?|days?|minutes?)\b|\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+\d{1,2}\b"
)
DEADLINE_LEXEMES = ("ends in", "ending in", "deal ends", "sale ends", "offer ends", "hurry", "expires", "time left", "left to buy", "reserved for", "held for", "expires in", "ends today")
CART_HOLD = r"\breserved for\b|\bheld for\b|\bcart expires\b"
CLOCK = r"\b\d{1,3}:[0-5]\d(?::[0-5]\d)?\b"
URGENCY_WEIGHTS = {"decrementing": 0.55, "clock": 0.2, "lexeme": 0.25, "hold": 0.15, "static": 0.4, "specific": 0.25}

# fixed values: other shoppers' activity
LIVE_COUNTERS = (
    r"\b(\d{1,4})\s*(?:other\s+)?(?:people|shoppers|customers|users|others)\s+(?:are\s+)?(?:viewing|looking at|watching|browsing)\b",
    r"\bviewing (?:this )?(?:right )?now\b",
    r"\b(\d{1,4})\s+(?:sold|bought|purchased|ordered)\s+in the (?:last|past)\s+\d+\s*(?:hour|hours|day|days|minute|minutes)\b",
    r"\b(\d{1,4})\s+(?:in|added to)\s+(?:\d+\s+)?(?:carts|baskets|bags)\b",
    r"\b(\d{1,4})\s+people (?:have )?(?:booked|reserved)\b",
    r"\b(\d{1,4})\s+(?:people|shoppers|customers|others)\s+(?:have\s+)?(?:bought|purchased|ordered|grabbed|claimed)\b",
    r"\blive\b[^a-z0-9]{0,4}(\d{2,6})\s*(?:watching|viewers?|viewing)\b",
    r"\bbooked\s+\d+\s+times? in (?:the )?last\b",
    r"\b(\d{1,5})\s+(?:other\s+)?(?:people|shoppers|customers|users|others)\s+(?:have\s+)?(?:viewed|looked at|watched|browsed)\b",
    r"\b(\d{1,5})\s+(?:sold|bought|purchased|booked|ordered)\s+(?:today|this (?:hour|week)|in the past)\b",
    r"\bpeople want this\b",
    r"\bin high demand\b",
    r"\b(\d{1,4})\s+others? (?:are )?(?:looking|interested)\b",
    r"\blive\b\s*[•·|‧∙]\s*(\d{2,6})\b(?!\s*(?:followers?|subscribers?|likes?))",
    r"\b(\d{1,5})\s+(?:other\s+)?(?:people|shoppers|customers|users|others)\s+(?:have|has|added)\b[^.!?]{0,24}?\b(?:carts?|bags?|baskets?)\b",
)
LIVE_RECENT = r"\bin the (?:last|past)\b|\bright now\b|\btoday\b"
LIVE_EXCLUDED = (r"\b\d[\d,]*\s+(?:reviews?|ratings?|questions?|answers?)\b", r"\b\d[\d,]*\s+(?:items?|products?|results?)\s+(?:found|available|match)", r"\bout of \d+ stars?\b")
OWN_PURCHASE = r"\b(?:you|your|i|we|my|our)\b"
JUST_NOW = r"\bjust\s+(?:bought|purchased|ordered|booked|claimed)\b|\b(?:moments?|\d{1,3}\s*(?:seconds?|secs?|minutes?|mins?|hours?|hrs?))\s+ago\b"
REVIEW_MARKERS = r"\b(?:verified (?:buyer|purchase|review)|reviews?|rated|stars?)\b|[\"“”]"
TOAST = r"\b(?:just|recently)\s+(?:bought|purchased|ordered|booked|signed up|joined|claimed)\b|\bsomeone (?:in|from)\s+[a-z]"
PLACE = r"\b(?:in|from)\s+[A-Z][a-z]+(?:[ ,][A-Z][a-z]+)?"
SOCIAL_WEIGHTS = {"counter": 0.55, "toast": 0.6, "named": 0.5, "place": 0.15, "recent": 0.2, "short": 0.1}

# fixed values: spend thresholds
AMOUNT = r"(?:[$£€¥₹]\s?[\d.,]*\d|\d[\d.,]*\s?(?:[$£€]|usd|eur|gbp|cad|aud)|\d{1,3}\s+(?:more\s+)?(?:items?|products?|pieces?|units?))"
REMAINDERS = tuple(
    p.replace("AMOUNT", AMOUNT)
    for p in (
        r"\byou'?re\s+(?:only\s+|just\s+)?AMOUNT\s+(?:more\s+)?away\b",
        r"\byou are\s+(?:only\s+|just\s+)?AMOUNT\s+(?:more\s+)?away\b",
        r"\b(?:only|just)\s+AMOUNT\s+(?:more\s+)?(?:away|to go|until|till)\b",
        r"\badd\s+(?:another\s+)?AMOUNT\s+(?:more\s+)?to (?:get|unlock|qualify|receive|(?:your\s+)?(?:cart|bag|basket))\b",
        r"\b(?:only|just|another)\s+AMOUNT\s+more\b",
        r"\bspend\s+(?:another\s+)?AMOUNT\s+(?:more\s+)?to (?:get|unlock|qualify)\b",
        r"(?:^|[^\w.,])AMOUNT\s+(?:more\s+)?away from (?:free|a free|your)\b",
        r"(?:^|[^\w.,])AMOUNT\s+(?:more\s+)?(?:until|till|to reach|to hit)\s+(?:free|your)\b",
        r"(?:^|[^\w.,])AMOUNT\s*(?:more\s+)?to go\b",
        r"(?:^|[^\w.,])AMOUNT\s*(?:more\s+)?(?:and|for)\s+(?:you\s+)?(?:get|unlock|qualify)\b",
        r"\balmost there\b.{0,40}\bfree (?:shipping|delivery)\b|\bfree (?:shipping|delivery)\b.{0,40}\balmost there\b",
    )
)
THRESHOLD_COPY = r"\bfree (?:shipping|delivery)\b|\bunlock (?:free|a )\b|\bqualif(?:y|ies) for\b|\bto reach\b"
MONEY_ISH = r"(?i)(?:[$£€¥₹₪₩]|R\$|MX\$|A\$|C\$|NZ\$)\s?[\d.,]+|[\d.,]+\s?(?:kr|€|₩|zł|Kč)\b|[\d.,]+\s?(?:usd|cad|aud|nzd|eur|gbp|sek|dkk|nok)\b"
THRESHOLD_PREP = r"(?i)\b(?:over|above|or more|minimum|min\.?\s*(?:spend|purchase|order)|when you spend|spend|purchase of|first order of|on orders?|orders? (?:over|above)|for every|qualifying)\b|\bwith\s+(?:any|select|your|min\.?)\b|\b[\d.,]+\+"
REWARD = r"(?i)\bfree\b|\bcomplimentary\b|\bgift\b|\b\d+%?\s*off\b|\boff\b|\bsample|\begift\b|\bvoucher\b|\bpromo card\b|\breward|\bdelivery\b|\bshipping\b|\bcash\b"
ADDRESSED = r"(?i)\b(?:you|your|spend|orders?|minimum|min\.)\b"
THRESHOLD_MET = r"(?i)\bfree (?:shipping|delivery)\s+unlocked\b|\bunlocked\s+free (?:shipping|delivery)\b|\byou(?:'ve| have)\s+(?:earned|unlocked|qualified for)\b"
GOAL_WEIGHTS = {"remainder": 0.6, "progress": 0.3, "copy": 0.2, "amount": 0.15, "policy": 0.45}

# fixed values: declines that shame
FIRST_PERSON = r"\bi\s+(?:don'?t|do not|hate|prefer|would rather|'?d rather|am not|like|enjoy|want|understand|acknowledge|accept|agree|will|shall)\b|\bi'?(?:m not|ll)\b|\bno,? i\b"
SHAMING = (
    r"\b(?:don'?t|do not) (?:want|like|need|care about) (?:to )?(?:save|saving|savings|discounts?|deals?|money|offers?)\b",
    r"\bhate (?:saving|savings|money|discounts?|deals?|free)\b",
    r"\b(?:would |'?d )?rather pay (?:full|more|retail)\b",
    r"\bi'?m not interested in (?:saving|savings|discounts?|deals?)\b",
    r"\bdon'?t (?:want|need) (?:to be )?(?:smart|informed|updated|in the know)\b",
    r"\bprefer (?:to pay )?full price\b",
    r"\bi like paying (?:full|more)\b",
    r"\bno thanks,? i\b",
    r"\bi enjoy (?:paying|missing out|overpaying)\b",
    r"\bi don'?t (?:want|need) (?:free|better|good)\b",
    r"\bi\s*(?:will|'?ll|am going to)\s+pay\s+(?:the\s+)?(?:full|more|retail|extra)\b",
    r"\b(?:don'?t|do not)\s+(?:want|like|need)\s+(?:my|the|this|your|any)\s+\w+",
    r"\bi'?ll (?:risk it|take my chances|pass on)\b",
    r"\b(?:i'?ll|i will|i'?d rather|i don'?t mind|i'?m (?:ok|okay|fine|happy)(?: with)?)\s+miss(?:ing)? out\b",
)
COSTLY_ACK = (
    r"\bi understand\b[^.]{0,80}\b(?:higher|more expensive|greater|increased|additional)\b[^.]{0,40}\b(?:price|cost|total|fare|fee)",
    r"\bi understand\b[^.]{0,80}\b(?:may|might|could|will) (?:result in|cost more|be charged)\b",
    r"\bi (?:acknowledge|accept|agree)\b[^.]{0,80}\b(?:higher|more|additional|extra)\b[^.]{0,40}\b(?:price|cost|fee|charge)",
)
NEUTRAL_DECLINE = r"^(?:no thanks?|no thank you|not now|maybe later|dismiss|close|cancel|skip|not right now|no)$|^(?:continue without|decline|opt out)\b"
DECLINE_HINT = r"\b(?:no|not|skip|dismiss|close|maybe later|decline|cancel)\b"
SHAME_WEIGHTS = {"shaming": 0.6, "first_person": 0.3, "control": 0.2, "modal": 0.1}

# fixed values: preselected extras
COSTLY = (
    "warranty", "protection plan", "protection", "insurance", "coverage", "accident", "donate", "donation", "round up", "tip", "gratuity", "newsletter", "marketing", "promotional", "special offers", "subscribe", "updates",
    "expedited", "express shipping", "priority shipping", "faster delivery", "shipping upgrade", "membership", "auto-renew", "auto renew", "subscription", "recurring", "gift wrap", "gift wrapping", "carbon offset", "signature confirmation",
)
BENIGN = ("remember me", "keep me signed in", "i am over", "i agree to the terms", "save my information for next time", "accept cookies")
OPTION_MOST = 160
PRESELECT_WEIGHTS = {"costly": 0.6, "price": 0.25, "dear_radio": 0.5, "late_stage": 0.15}

# fixed values: stages in which each detector runs
DETECTOR_STAGES = {
    "scarcity.stock": ("pdp", "cart", "browse"),
    "urgency.countdown": ("pdp", "cart", "checkout", "browse"),
    "social_proof.live_activity": ("pdp", "browse", "cart", "checkout"),
    "confirmshaming.decline_copy": ("browse", "pdp", "cart", "checkout"),
    "goal_gradient.threshold": ("cart", "checkout", "pdp"),
    "defaults.preselected": ("pdp", "cart", "checkout", "payment"),
    "anchoring.reference_price": ("pdp", "browse", "cart"),
    "pricing.charm": ("pdp", "browse"),
    "nagging.repeat_interstitial": ("browse", "pdp", "cart", "checkout"),
    "decoy.asymmetric_dominance": ("pdp", "browse", "cart"),
    "framing.savings_ratio": ("pdp", "browse", "cart"),
    "interference.visual_asymmetry": ("browse", "pdp", "cart", "checkout", "payment"),
}

# fixed values: accepting and declining, leaving, and stating a saving
ACCEPT = r"\b(?:accept|allow|agree|continue|yes|ok|got it|sounds good|sign me up|subscribe|get \d+% off|claim|unlock|save now)\b"
PURCHASE = r"\b(?:add to (?:cart|bag|basket)|buy now|check ?out|place order|pay now)\b"
DECLINE = r"\b(?:decline|no thanks?|no thank you|not now|maybe later|skip|dismiss|cancel|reject|opt out|continue without|not interested|close)\b"
GLYPH = r"^[\s×✕✖xX✗+·—–-]*$"
EXIT_COPY = r"\b(?:wait|don't go|dont go|before you go|before you leave|leaving so soon|hold on|one more thing|your cart is waiting|still thinking|don't miss)\b"
EXIT_OFFER = r"\b\d{1,2}%\s*off\b|\bfree shipping\b|\bcoupon\b|\bdiscount\b"
PERCENT_CLAIM = r"(\d{1,2})\s*%\s*(?:off|discount|savings?|less)\b|\bsave\s*(\d{1,2})\s*%"
ABSOLUTE_CLAIM = r"\b(?:you\s+)?save\s+(?:up\s+to\s+)?[$£€¥₹]\s?\d|[$£€¥₹]\s?[\d.,]*\d\s*(?:off|discount)\b"
CLAIM_BEFORE, CLAIM_AFTER = r"(?:\b(?:you\s+)?saves?\b|\bsaving\b|\bup\s+to\b|\bextra\b)\s*$", r"^\s*(?:off|discount)\b"
CLAIM_REACH, PAIR_GAP, REFERENCE_REACH, FLATTERS = 12, 32, 24, 2
MARKDOWN_WORD = r"\b(?:now|was|then|sale|flash|deal|price|prices|save|saves|saving|savings|off|you|up|to|from|msrp|reg|orig|originally|list|retail|compare|at|our|your|today|only|member|extra|coupon|clearance)\b"
REFERENCE_WORD = r"(?:was|msrp|reg\.?|regular price|orig\.?|originally|list price|compare at|compare to|retail price)\s*:?\s*$"
FRAMING_WEIGHTS = {"percent": 0.5, "absolute": 0.5, "both": 0.25, "large": 0.2, "reference": 0.15}

# fixed values: reference prices
ANCHOR_WORDS = ("was", "msrp", "compare at", "compare to", "list price", "orig.", "originally", "reg.", "regular price", "you save", "retail price")
PERCENT_BADGE = r"\b\d{1,2}%\s*off\b|\b-\s?\d{1,2}%"
ANCHOR_WEIGHTS = {"struck": 0.45, "two": 0.2, "lexeme": 0.2, "badge": 0.15, "higher": 0.15}
ANCHOR_REACH, LEAST_PERCENT, LEAST_GAP, SMALL_GAP_MOST = 3, 15, 500, 0.6

# fixed values: charm prices and decoys
CHARM_FRACTIONS, CHARM_MOST, PRIMARY_AREA = ("99", "95", "97", "98"), 60, 400
CHARM_WEIGHTS = {"charm": 0.6, "cents": 0.25, "primary": 0.2}
BADGE = r"\b(?:most popular|best value|best deal|recommended|most chosen|our pick|popular choice|best seller)\b"
DECOY_WEIGHTS = {"badge": 0.65, "dominated": 0.55, "three": 0.15, "spread": 0.15}

# fixed values: words of which one makes a text worth a detector's time
TRIGGERS = (
    "only", "left", "stock", "hurry", "ends", "expires", "sold", "viewing", "people", "was", "msrp", "compare", "list", "orig", "save", "off", "deal", "reserved", "held", "away from", "add", "unlock", "spend", "free shipping",
    "no thanks", "i don", "i'd rather", "i understand", "i acknowledge", "i accept", "almost gone", "selling fast", "last ticket", "last seat", "last room", "last spot", "last pair", "in carts", "going fast", "supplies last",
    "limited quantity", "limited availability", "last chance", "few left", "bought", "purchased", "ordered", "booked", "just", "someone", "claimed", "signed up", "qualify", "to go", "ending", "expiring", "closes", "sale", "offer",
    "tonight", "final hours", "don't miss", "act now", "back in stock", "pay later", "pay over time", "fill up fast", "selling out", "unlocked", "viewed", "want this", "space limited", "spaces are limited", "price increases",
    "prices go up", "pay full price", "risk it",
)

#: Of patterns that are dear to try: what a text (in lower case) must hold one of for any of them to match. A test takes the patterns apart.
NEEDED = {
    STOCK_NUMERIC: (" in stock", " item", "available", "left", "only ", "remaining"),
    STOCK_WORDS: (" fast", "almost ", "back in stock soon", "before ", "hurry", "last ", "limited", "low stock", "while s", "while they last"),
    STOCK_VARIANTS: ("available", "left", "out of stock", "remaining", "sold out"),
    DEADLINE: (" only", "book", "buy", "coupon", "deal", "discount", "event", "hurry", "last ", "left", "limited", "nd", "offer", "order", "price", "promo", "sale", "shop", "thr", "xpire", "xpiring"),
    LIVE_COUNTERS: ("bags", "baskets", "booked", "browsed", "browsing", "carts", "customers", "in high demand", "in the ", "interested", "live", "looked at", "looking", "others", "people", "shoppers", "this ", "today", "users", "viewed", "viewer", "viewing", "watched", "watching"),
    LIVE_EXCLUDED: ("answer", "available", "found", "match", "out of ", "question", "rating", "review"),
    REMAINDERS: ("add", "almost there", "and", "away", "for", "free", "just", "more", "only", "spend", "to go", "you are", "your"),
    SHAMING: ("care about", "extra", "full", "hate ", "i don", "i enjoy ", "in the know", "informed", "like", "m not interested in ", "miss", "more", "need", "no thanks", "pass on", "rather pay ", "retail", "risk it", "smart", "take my chances", "updated", "want"),
    COSTLY_ACK: ("ccept", "cknowledge", "gree", "i understand"),
    TOAST: ("booked", "bought", "claimed", "joined", "ordered", "purchased", "signed up", "someone "),
    THRESHOLD_COPY: ("delivery", "qualif", "shipping", "to reach", "unlock "),
    THRESHOLD_MET: ("earned", "qualified for", "unlocked"),
    REWARD: ("cash", "complimentary", "delivery", "free", "gift", "off", "promo card", "reward", "sample", "shipping", "voucher"),
}
