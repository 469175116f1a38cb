"""Word lists and weighted patterns, all of them parameters of the operators that use them.

Lists are in alphabetical order, which is also how ties are broken.
"""

VERBS = sorted(
    """achieve affect analyze assess compare conduct confirm contribute decrease demonstrate describe determine enhance evaluate
    examine find identify improve increase indicate influence investigate measure observe obtain perform present provide
    reduce report require reveal show study suggest support""".split()
)
ADJECTIVES = sorted(
    """critical current different essential general high important key large low main major negative new novel particular
    positive previous primary recent significant similar small specific strong various weak""".split()
)
TRANSITIONS = sorted(
    """additionally also although because consequently conversely finally furthermore hence however importantly moreover
    nevertheless notably particularly similarly since specifically therefore thus whereas while""".split()
)
AVOIDED = sorted("ascertain commence elucidate endeavor facilitate leverage paramount plethora procure utilize".split())
DISCOURSE = sorted(
    """accordingly consequently conversely especially furthermore hence however importantly indeed interestingly intriguingly
    moreover nevertheless notably particularly remarkably significantly specifically strikingly surprisingly therefore thus unexpectedly""".split()
)
SUBORDINATORS = sorted("after although because before if since that unless until when where whereas whereby wherein whether which while who whom whose".split())
HEDGES = sorted("apparently appears could indicates likely may might perhaps possibly potentially presumably seems suggests unlikely would".split())
PRECISION = sorted("considerably dramatically drastically essentially exclusively markedly predominantly primarily profoundly specifically substantially virtually".split())
PASSIVE_VERBS = sorted("analyzed demonstrated detected determined found identified measured observed reported shown".split())
AUXILIARIES = sorted("are been being is was were".split())
PHRASES = sorted(["as a result", "in addition", "in contrast", "in this context", "it is noteworthy", "it should be noted", "of particular interest", "on the other hand", "taken together", "to this end"])

#: (name, pattern, weight) of phrases that raise the pattern score.
PATTERNS = [
    ("First/Second/Third", r"first(ly)?,.*second(ly)?,.*third(ly)?,", 0.08),
    ("a wide range of", r"\ba wide (array|range|variety) of\b", 0.05),
    ("It is important to note", "it is important to note", 0.10),
    ("It is worth noting", "it is worth noting that", 0.10),
    ("It should be noted", "it should be noted", 0.08),
    ("plays a crucial role", r"\bplays a (crucial|pivotal|vital) role\b", 0.06),
    ("Additionally", r"\badditionally\b", 0.06),
    ("Consequently", r"\bconsequently\b", 0.05),
    ("Furthermore", r"\bfurthermore\b", 0.08),
    ("Moreover", r"\bmoreover\b", 0.08),
    ("facilitate", r"\bfacilitate[ds]?\b", 0.05),
    ("leverage", r"\bleverage[ds]?\b", 0.06),
    ("utilize", r"\butilize[ds]?\b", 0.05),
]

#: By name, what every match of a pattern holds, in lower case.
PARTS = {
    "First/Second/Third": "second", "a wide range of": "a wide ", "It is important to note": "important to note", "It is worth noting": "worth noting", "It should be noted": "should be noted",
    "plays a crucial role": "plays a ", "Additionally": "additionally", "Consequently": "consequently", "Furthermore": "furthermore", "Moreover": "moreover",
    "facilitate": "facilitate", "leverage": "leverage", "utilize": "utilize",
}

#: Artifacts of journal pages, removed in this order.
ARTIFACTS = [
    r"this journal is © the royal society of chemistry [0-9]{4}",
    r"© the royal society of chemistry [0-9]{4}",
    r"nat\.? prod\.? rep\.?",
    "natural product reports",
    "this article is licensed under a creative commons",
    r"downloaded by [a-z\s/]+ on [0-9]{1,2}/[0-9]{1,2}/[0-9]{4} [0-9]{1,2}:[0-9]{2}:[0-9]{2} [ap]m\.?",
    r"downloaded by universiteit leiden[^.]*\.",
    r"downloaded by university of[^.]*\.",
    r"published on [0-9]{1,2} [a-z]+ [0-9]{4}\.",
    "view article online",
    "this journal is ©",
    r"doi: 10\.[0-9]{4,5}/[^\s]+",
    r"www\.rsc\.org/[^\s]+",
]
#: What every match of the artifacts holds, in lower case.
ARTIFACT_PARTS = [
    "this journal is ©", "royal society of chemistry", "prod", "natural product reports", "creative commons", "downloaded by", "downloaded by", "downloaded by", "published on",
    "view article online", "this journal is ©", "doi: 10.", "www.rsc.org/",
]

#: Bibliography tests: [(pattern, [(least count, points), ...])], the first that holds counts.
BIBLIOGRAPHY_A = [
    (r"[A-Z][a-z]+(,\s*[A-Z]\.[A-Z]?\.?)?\s+(et al\.?\s*)?\((19|20)[0-9]{2}\)", [(4, 2), (2, 1)]),
    (r"[A-Z][a-z]+\.?\s*,?\s*[0-9]+,\s*[0-9]+[-–][0-9]+", [(3, 2), (1, 1)]),
    (r"^[A-Z][a-z]+,?\s*[A-Z]\.", [(1, 1)]),
    (r"10\.[0-9]{4,}/", [(2, 2), (1, 1)]),
    (r"\((19|20)[0-9]{2}\)", [(6, 2), (4, 1)]),
]
JOURNALS_A = [r"Annu\.\s+Rev\.", r"J\.\s+[A-Z][a-z]+\.", r"Nat\.\s+[A-Z][a-z]+", r"Proc\.\s+Natl"]
BIBLIOGRAPHY_B = [
    (r"[A-Z][a-z]+\.\s+[A-Z][a-z]+\.\s*[A-Z]?[a-z]*\.?", [(2, 3), (1, 1)]),
    (r"[0-9]+:[0-9]+[-–][0-9]+", [(2, 3), (1, 2)]),
    (r"[0-9]+,\s*[0-9]+[-–][0-9]+", [(2, 2), (1, 1)]),
    (r"\b(19|20)[0-9]{2}\.", [(3, 2)]),
    (r"[A-Z][a-z]+\s+[A-Z]{1,2}[,.].*?(19|20)[0-9]{2}", [(3, 2), (1, 1)]),
    (r"10\.[0-9]{4,}/", [(1, 2)]),
    (r"\b[0-9]{1,3}\.\s+[A-Z][a-z]+\s+[A-Z]", [(2, 2)]),
]

#: Sections in order of preference, and what their openings mention.
SECTIONS = [
    ("Abstract", ["abstract", "here we show", "in this study", "summary", "we demonstrate", "we report"]),
    ("Introduction", ["has attracted attention", "has been shown", "however, little is known", "in recent years", "introduction", "it is known", "previous studies", "remains unclear"]),
    ("Methods", ["materials and methods", "methods", "pcr", "primers", "protocol", "sequencing", "strains were", "was extracted", "was performed", "were cultured"]),
    ("Results", ["analysis revealed", "as shown in", "fig.", "figure", "results", "table", "the results show", "we found that", "we observed"]),
    ("Discussion", ["consistent with", "discussion", "future studies", "in contrast to", "limitations", "our findings", "taken together", "these results suggest"]),
    ("Conclusion", ["collectively", "conclusion", "in conclusion", "in summary", "overall,"]),
]
