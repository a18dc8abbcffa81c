"""Tags, word lists and regular expressions of the SMILES rules.

Every expression here is plain enough for both Java (Spark) and RE2 (the SQL
check) unless its name ends in ``_JAVA``.
"""

# --- Fixed values: they must be these for results to be right. ---------------

START_TAG = "[START_SMILES]"
END_TAG = "[END_SMILES]"

SPECIAL_TOKENS = ["[UNK]", "[PAD]", "[BOS]", "[EOS]"]

# The 118 elements in order of atomic number.
ELEMENT_NAMES = dict(
    pair.split()
    for pair in """
    H Hydrogen, He Helium, Li Lithium, Be Beryllium, B Boron, C Carbon, N Nitrogen,
    O Oxygen, F Fluorine, Ne Neon, Na Sodium, Mg Magnesium, Al Aluminum, Si Silicon,
    P Phosphorus, S Sulfur, Cl Chlorine, Ar Argon, K Potassium, Ca Calcium,
    Sc Scandium, Ti Titanium, V Vanadium, Cr Chromium, Mn Manganese, Fe Iron,
    Co Cobalt, Ni Nickel, Cu Copper, Zn Zinc, Ga Gallium, Ge Germanium, As Arsenic,
    Se Selenium, Br Bromine, Kr Krypton, Rb Rubidium, Sr Strontium, Y Yttrium,
    Zr Zirconium, Nb Niobium, Mo Molybdenum, Tc Technetium, Ru Ruthenium, Rh Rhodium,
    Pd Palladium, Ag Silver, Cd Cadmium, In Indium, Sn Tin, Sb Antimony, Te Tellurium,
    I Iodine, Xe Xenon, Cs Cesium, Ba Barium, La Lanthanum, Ce Cerium,
    Pr Praseodymium, Nd Neodymium, Pm Promethium, Sm Samarium, Eu Europium,
    Gd Gadolinium, Tb Terbium, Dy Dysprosium, Ho Holmium, Er Erbium, Tm Thulium,
    Yb Ytterbium, Lu Lutetium, Hf Hafnium, Ta Tantalum, W Tungsten, Re Rhenium,
    Os Osmium, Ir Iridium, Pt Platinum, Au Gold, Hg Mercury, Tl Thallium, Pb Lead,
    Bi Bismuth, Po Polonium, At Astatine, Rn Radon, Fr Francium, Ra Radium,
    Ac Actinium, Th Thorium, Pa Protactinium, U Uranium, Np Neptunium, Pu Plutonium,
    Am Americium, Cm Curium, Bk Berkelium, Cf Californium, Es Einsteinium, Fm Fermium,
    Md Mendelevium, No Nobelium, Lr Lawrencium, Rf Rutherfordium, Db Dubnium,
    Sg Seaborgium, Bh Bohrium, Hs Hassium, Mt Meitnerium, Ds Darmstadtium,
    Rg Roentgenium, Cn Copernicium, Nh Nihonium, Fl Flerovium, Mc Moscovium,
    Lv Livermorium, Ts Tennessine, Og Oganesson
    """.split(",")
)

# Words that are never SMILES.
STOP_WORDS = """
    I In On No So Up A a Be Am As At Is Or Go Us By To It Re Pm Mt UV at
    BIS BWB CISCO COOKBOOK CV FON HH HNH IP ISBN NOS NSF PPO SH SI SS UPS UNKNOWN WHY
    WWI US UK U.S W.H II III IV VI VII VIII IX [HAW93] B/c C-2 C-4 Sc1
    SS1 SS2 SS3 SS4 SS5 SS6
""".split()

# Formulas that are SMILES only after a word with one of these endings.
CONTEXT_SUFFIXES = {
    "IF": ["fluoride"],
    "HF": ["fluoride", "acid"],
    "NO": ["oxide"],
    "CO": ["monoxide", "oxide"],
}

# Punctuation stripped from a token, and from the word before it.
TOKEN_PUNCTUATION = ".,;:!?\"'"
PREVIOUS_PUNCTUATION = ".,;:!?\"'()[]{}"

AROMATICS = "bcnops"
# Bonds, branches, ring and charge marks of the detection grammar.
DETECTION_SPECIAL = r"[\p{Nd}=#\-+.\\/@%()]"
# Single-character symbols of the token grammar (a single backslash is not one,
# two in a row are).
TOKEN_SYMBOLS = r"().=#\-+/:~@?>*$"
DOUBLE_BACKSLASH = r"\\\\"
RING_NUMBER = "%[0-9]{2}"

# Topics of the multiple-choice benchmark.
TOPICS = [
    "analytical_chemistry",
    "chemical_preference",
    "general_chemistry",
    "inorganic_chemistry",
    "materials_science",
    "organic_chemistry",
    "physical_chemistry",
    "technical_chemistry",
    "toxicity_and_safety",
]

# --- Rules derived from the values above. ------------------------------------

ELEMENTS = list(ELEMENT_NAMES)


def _longest_first(symbols: list[str]) -> str:
    """One alternative per first letter; the optional second letter is greedy,
    so two-letter symbols win over their one-letter prefix."""
    alternatives = []
    for first in sorted({s[0] for s in symbols}):
        second = "".join(sorted(s[1] for s in symbols if s[0] == first and len(s) == 2))
        optional = "?" if first in symbols else ""
        alternatives.append(f"{first}[{second}]{optional}" if second else first)
    return "|".join(alternatives)


ELEMENT = _longest_first(ELEMENTS)
# The same for Java, which tries alternatives one by one: other characters fail at once.
ELEMENT_JAVA = f"(?=[A-Z])(?:{ELEMENT})"
_ONE_LETTER = "".join(s for s in ELEMENTS if len(s) == 1)
BRACKET = r"\[[^\]]+\]"

# Whitespace as a Python string method sees it.
SPACE = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
SPACES = f"[{SPACE}]+"
STRIP = f"^[{SPACE}]+|[{SPACE}]+$"

# Characters peeled off both ends of a word: not word characters, not brackets.
_PEEL = rf"[^\p{{L}}\p{{N}}_\[\]{SPACE}]"
PEEL_ENDS = f"^{_PEEL}*|{_PEEL}+$"
PEEL_START = f"^{_PEEL}*"
PEEL_END = f"{_PEEL}*$"

# Tagged segments: across lines for extraction, on one line elsewhere.
_START_RE = r"\[START_SMILES\]"
_END_RE = r"\[END_SMILES\]"
TAGGED = rf"(?s){_START_RE}(.*?){_END_RE}"
TAGGED_ONE_LINE = rf"{_START_RE}([^\n]*?){_END_RE}"
TAGGED_SPLIT = rf"({_START_RE}[^\n]*?{_END_RE})"

# Detection.
DETECTION_TOKEN = f"{BRACKET}|{ELEMENT}|[{AROMATICS}]|{DETECTION_SPECIAL}"
DETECTION_WHOLE = f"^(?:{DETECTION_TOKEN})+$"
# Possessive loops do not recurse, so a very long word cannot overflow the stack.
DETECTION_TOKEN_JAVA = DETECTION_TOKEN.replace(ELEMENT, ELEMENT_JAVA)
DETECTION_WHOLE_JAVA = f"^(?:{DETECTION_TOKEN_JAVA})++$"
CANDIDATE_WORD_JAVA = f"^{_PEEL}*+(?:{DETECTION_TOKEN_JAVA})++{_PEEL}*+$"
CAPITAL_OR_DIGIT = r"[A-Z\p{Nd}]"

# Tokenizers.
_SYMBOL_TAIL = f"{DOUBLE_BACKSLASH}|{RING_NUMBER}|[0-9]"
ELEMENT_TOKEN = rf"{ELEMENT}|[{AROMATICS}\[\]{TOKEN_SYMBOLS}]|{_SYMBOL_TAIL}"
BRACKET_ATOM_TOKEN = f"{BRACKET}|{ELEMENT}|[{AROMATICS}{TOKEN_SYMBOLS}]|{_SYMBOL_TAIL}"
ELEMENT_TOKEN_JAVA, BRACKET_ATOM_TOKEN_JAVA = (t.replace(ELEMENT, ELEMENT_JAVA) for t in (ELEMENT_TOKEN, BRACKET_ATOM_TOKEN))
ONE_CHARACTER_TOKEN = f"[{_ONE_LETTER}{AROMATICS}{TOKEN_SYMBOLS}0-9]"
ATOM_TOKEN = f"{BRACKET}|Br?|Cl?|[NOSPFI{AROMATICS}{TOKEN_SYMBOLS}]|{_SYMBOL_TAIL}"
CHARACTER_TOKEN = r"[^\n]"
WORD_TOKEN_JAVA = r"(?U)\w+|[^\w\s]+"
WORD_TOKEN_RE2 = (
    rf"[\p{{L}}\p{{M}}\p{{Nd}}\p{{Nl}}\p{{Pc}}]+"
    rf"|[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Nl}}\p{{Pc}}{SPACE}]+"
)
