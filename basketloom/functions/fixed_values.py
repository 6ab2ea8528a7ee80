"""Fixed values.

These lists must equal the values that the results are defined by, in this order: the first
alternative that matches wins.  They are plain regular-expression fragments.
"""

# Number words and what they stand for, in matching order.
NUMBER_WORDS = (
    ("an?", 1), ("one", 1), ("two", 2), ("three", 3), ("four", 4), ("five", 5), ("six", 6),
    ("seven", 7), ("eight", 8), ("nine", 9), ("ten", 10),
    ("(?:a )?half(?: of)?", 0.5), ("(?:a )?quarter(?: of)?", 0.25),
)

# Standard units and their spellings.
STANDARD_UNITS = (
    ("in", ("inche?s?", "in", '"')),
    ("cm", ("cms?",)),
    ("fl oz", (r"fl\.? oz\.?", "fluid ounces?")),
    ("pt", ("pints?", r"pts?\.?")),
    ("qt", (r"quarts?\.?", r"qts?\.?")),
    ("gal", (r"gals?\.?", "gallons?")),
    ("lb", (r"lbs?\.?", "pounds?")),
    ("g", (r"grms?\.?", "grams?", "grammes?", r"gs?\.?")),
    ("kg", ("kilograms?", "kilogramme?s?", r"kgs?\.?")),
    ("ml", ("mls?", "milliliters?", "millilitres?")),
    ("l", ("liters?", "litres?", r"l\.?")),
    ("tsp", ("teaspoons?", r"tspn?s?\.?")),
    ("tbsp", ("tablespoons?", r"tbsp?n?s?\.?")),
    ("oz", (r"ounces?\.?", r"ozs?\.?")),
    ("cups", ("cups?", r"c\.")),
    ("whole", ("whole",)),
    ("half", ("half", "halves")),
    ("dozens", (r"dozens?\.?",)),
)

# Container and count units and their spellings.
COUNT_UNITS = (
    ("bags", ("bags?",)),
    ("balls", ("balls?",)),
    ("bars", ("bars?",)),
    ("barspoons", ("barspoons?",)),
    ("batches", ("batch(?:es)?",)),
    ("blocks", ("blocks?",)),
    ("bottles", ("bottles?",)),
    ("boxes", ("box(?:es)?",)),
    ("bunches", ("bunche?s?", "bn")),
    ("cans", (r"cans?\.?",)),
    ("cartons", (r"cartons?\.?",)),
    ("cloves", ("cloves?", "cloves? of", r"clvs?\.?")),
    ("containers", (r"containers?\.?",)),
    ("dashes", ("dashe?s?", r"dsh\.?")),
    ("drops", ("drops?",)),
    ("drizzle", ("drizzles?", "drizzles? of")),
    ("envelopes", ("envelopes?",)),
    ("grinds", ("grinds?",)),
    ("handfuls", ("handfuls?",)),
    ("heads", ("heads?",)),
    ("jars", ("jars?",)),
    ("knobs", ("knobs?",)),
    ("leaves", ("leaf", "leaves")),
    ("legs", ("legs?",)),
    ("loaves", ("loaf", "loaves")),
    ("packets", ("packets?", r"pkts?\.?")),
    ("packages", ("packages?", r"pkgs?\.?")),
    ("pieces", ("pieces?",)),
    ("pinches", ("pinche?s?", r"pchs?\.?")),
    ("pouches", ("pouche?s?",)),
    ("racks", ("racks?",)),
    ("rashers", ("rashers?",)),
    ("scoops", ("scoops?",)),
    ("sheets", ("sheets?",)),
    ("slices", ("slices?", r"slcs?\.?")),
    ("sprigs", ("sprigs?", r"sprgs?\.")),
    ("stalks", ("stalks?",)),
    ("sticks", ("sticks?",)),
    ("strips", ("strips?",)),
    ("taste", ("taste",)),
    ("tins", ("tins?",)),
    ("tubs", ("tubs?",)),
)

# Things that are juiced, and what may be taken from them besides juice.
JUICED = (
    "oranges?", "lemons?", "limes?", "grapefruits?", "tangerines?", "mango", "mangoes",
    "(?:rasp|black|blue|cran|straw)(?:berry|berries)", "ginger", "garlic", "carrots?",
    "clementines?", "pomegranates?", "apples?", "(?:cherry|cherries)", "plums?", "oysters?",
    "clams?", "coconuts?", "(?:water)?melons?", "tomato(?:es)?", "tangelo",
)
JUICE_PARTS = ("seeds?", "grated", "rind", "zest", "peel", "juice", "and", "skin")

# Whole numbers that stand for a fraction whose slash was lost.
LOST_SLASH = ((12, 0.5), (13, 0.33), (14, 0.25), (23, 0.67), (34, 0.75))

# Openings of a line that lists equipment, and of a note.
EQUIPMENT_OPENINGS = ("equipment", "special equipment")
NOTE_OPENING = "note"

# Substrings that mark an item name as a parsing error.
BAD_NAME_PARTS = (
    " or ", " for the ", ",", " and ", " not ", " with ", " in ", "'s", "*", "(", "slices ",
    " cup ", "&", ";", ". ", "..", "+", "available", "accompaniment", "to taste", "additional",
    " plus ", " more ", " i like ", " you like ", "/", " of ", " much ", " needed ",
    "any ", "add ", "if ", "as well as ",
)
BAD_NAME_OPENING = "each "

# Openings that a parent name may not have, and the trademark signs.
BAD_PARENT_OPENINGS = ("and ", "'n ", "&")
TRADEMARK_SIGNS = ("®", "™")

# Characters that count as white space when text is stripped.
WHITE_SPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
