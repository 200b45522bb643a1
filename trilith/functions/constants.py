"""Fixed values.

FIXED VALUES: these lists and numbers must equal the reference application's
for identical results (stop lists, keyword lexicon, category and site names,
physical bounds, serving defaults, rule-score weights).  They are stated here
once, in their natural order.
"""

# FIXED VALUES -- label classes, code-point order.
CATEGORIES = ["Métal", "Papier", "Plastique", "Verre"]

# FIXED VALUES -- collection sites with their fixed serving codes.
SOURCES = ["Centre_Tri", "Collecte_Citoyenne", "Usine_A", "Usine_B"]
SOURCE_CODES = {"Centre_Tri": 0, "Collecte_Citoyenne": 1, "Usine_A": 2, "Usine_B": 3}

# FIXED VALUES -- label shown for a missing class.
UNLABELLED = "Non labellisé"

# FIXED VALUES -- characters kept by the text cleaner (everything else -> space).
KEEP_CHARS = "a-zàâäéèêëîïôùûüçœ"

# FIXED VALUES -- domain stop-words added to the French list (training list of 11).
DOMAIN_STOPWORDS = ["déchet", "matériau", "collecte", "objet", "article",
                    "type", "matière", "élément", "produit", "item", "lot"]

# FIXED VALUES -- Spark ML's default French stop list (public), in its own order.
FRENCH_STOPWORDS = tuple("""
au aux avec ce ces dans de des du elle en et eux il je la le les leur lui ma mais me même mes moi
mon ne nos notre nous on ou par pas pour qu que qui sa se ses son sur ta te tes toi ton tu un une
vos votre vous c d j l à m n s t y été étée étées étés étant étante étants étantes suis es est
sommes êtes sont serai seras sera serons serez seront serais serait serions seriez seraient étais
était étions étiez étaient fus fut fûmes fûtes furent sois soit soyons soyez soient fusse fusses fût
fussions fussiez fussent ayant ayante ayantes ayants eu eue eues eus ai as avons avez ont aurai
auras aura aurons aurez auront aurais aurait aurions auriez auraient avais avait avions aviez
avaient eut eûmes eûtes eurent aie aies ait ayons ayez aient eusse eusses eût eussions eussiez
eussent
""".split())

# FIXED VALUES -- basic stop list of the fallback tokenizer (30 words).
BASIC_STOPWORDS = ["le", "la", "les", "de", "du", "des", "un", "une", "et",
                   "est", "en", "au", "aux", "ce", "se", "sa", "son", "ses",
                   "sur", "par", "pour", "avec", "dans", "qui", "que", "ne",
                   "pas", "plus", "très", "bien"]

# FIXED VALUES -- keyword lexicon per class for the keyword scorer.
KEYWORDS = {
    "Métal": ["métal", "acier", "fer", "conducteur", "rigide", "lourd"],
    "Papier": ["papier", "carton", "emballage", "léger", "souple"],
    "Plastique": ["plastique", "pet", "bouteille", "synthétique"],
    "Verre": ["verre", "transparent", "cassant", "flacon"],
}

# FIXED VALUES -- physical cleaning bounds: value kept when lo < x <= hi.
PHYSICAL_BOUNDS = {
    "Poids": (0.0, 500.0),
    "Volume": (0.0, None),
    "Prix_Revente": (0.0, 1000.0),
}

# FIXED VALUES -- request validation bounds: (lo, lo_inclusive, hi, hi_inclusive).
REQUEST_BOUNDS = {
    "Poids": (0.0, False, 500.0, True),
    "Volume": (0.0, False, 500.0, True),
    "Conductivite": (0.0, True, 1.0, True),
    "Opacite": (0.0, True, 1.0, True),
    "Rigidite": (1.0, True, 10.0, True),
}

# FIXED VALUES -- defaults for a text-only request.
TEXT_ONLY_DEFAULTS = {"Poids": 50.0, "Volume": 100.0, "Conductivite": 0.5,
                      "Opacite": 0.5, "Rigidite": 5.0, "Source_enc": 0}

# FIXED VALUES -- divisors of the physical profile chart.
PROFILE_DIVISORS = {"Poids": 500.0, "Volume": 500.0, "Conductivite": 1.0,
                    "Opacite": 1.0, "Rigidite": 10.0}

# FIXED VALUES -- rule scores (conductivity c, opacity o, rigidity r in [1,10]).
RULE_WEIGHTS = {
    "Métal": {"c": 0.6, "r": 0.3, "const": 0.05},
    "Papier": {"1-c": 0.4, "1-r": 0.4, "const": 0.1},
    "Plastique": {"1-c": 0.3, "o": 0.4, "const": 0.2},
    "Verre": {"1-o": 0.5, "1-c": 0.3, "const": 0.1},
}

# FIXED VALUES -- accent folding of the label slug.
SLUG_FOLD = {"é": "e", "è": "e", "â": "a"}

# FIXED VALUES -- split proportions and tolerance of the split check.
SPLIT_FRACTIONS = (0.70, 0.15, 0.15)
SPLIT_TOLERANCE = 0.02
