"""Closed word classes of French (and some English) argument markers, as Java regular expressions.

All are applied with Unicode classes and without case; ``Q`` stands for either apostrophe.
Those whose name ends in FOLDED are applied to folded text (lower case, no accents).
"""

FLAGS = "(?iuU)"
Q = "['’]"
PRONOUNS = "(?:il|elle|on|ils|elles)"
BLANKS = "\\ \\t\\r\\n\\u00a0\\u202f"

# Connectors inside a sentence whose text belongs to neither side.
INLINE = rf"et\s+à\s+la\s+condition\s+que|que\s+s{Q}{PRONOUNS}|que\s+si|s{Q}{PRONOUNS}|si|quand|lorsque|dès\s+que|only\s+if|if|when|parce\s+que|because|provided\s+that|à\s+(?=qui\b)"
NOMINAL = rf"(?:à\s+l{Q}échéance|en\s+cas\s+de)\b"
ABBREVIATIONS = "no|art|al|p|pp|cf|vs"
CONDITIONAL_HEAD = rf"(?:mais\s+)?(?:si|s{Q}|if|quand|lorsque|when)\b"
INSERTION = rf"(?:y\s+compris|entre\s+autres|notamment|à\s+savoir|le\s+cas\s+échéant|en\s+particulier|(?:ou|et)\s+(?:de\s|d{Q}|à\s)|d{Q})"

# What opens or links propositions.
CONDITION = (
    rf"^\s*(?:mais\s+)?(?:si\b|s{Q}{PRONOUNS}\b|quand\b|lorsqu|comme\b|puisque\b|étant\s+donné\s+que\b|chez\b|dès\s+que\b|dans\s+(?:cette\s+situation|ce\s+cas)\b|"
    rf"en\s+l{Q}absence\s+de\b|en\s+présence\s+d|à\s+l{Q}échéance\b|en\s+cas\s+de\b|pour\s+(?:économiser|éviter|réduire|garantir|assurer)\b)"
)
SHORT_CIRCUMSTANCE = r"^\s*en\b"
ARTICULATION = r"^\s*en\s+revanche\s*$"
GAP_CONNECTOR = rf"^\s*(?:que\s+s{Q}{PRONOUNS}|que\s+si|s{Q}{PRONOUNS}|si|quand|lorsque|dès\s+que|only\s+if|if|when|parce\s+que|because|provided\s+that|à)\s*$"
RANKING_WITHOUT_RULE = r"\bprioritaire\s+par\s+rapport\s+[àa]\b|\bpr[ée]f[èe]re?\b.*\bmême\s+en\b"
TOPIC = r"^\s*(?:lui|elle|eux|elles)\b"
DEMONSTRATIVE = r"^\s*(?:un\s+tel|une\s+telle|de\s+tels|de\s+telles|ce|cet|cette|ces)\b"
COORDINATED = r"^\s*(?:(?:et|ou)\s+(?:que|si|lorsque|quand)|sans)\b"
NOMINAL_HEAD = rf"^\s*{NOMINAL}"
SAME_SENTENCE = r"^[\s,:—–-]*$"
LINK = rf"(?:\bou\s+(?:si\b|s{Q}{PRONOUNS}\b)|\bet\s+à\s+la\s+condition\s+que)\s*$"
OR_LINK = rf"\bou\s+(?:si\b|s{Q}{PRONOUNS}\b)\s*$"
CONSEQUENCE = rf"^\s*(?:et\s+|puis\s+)?(?:donc|par\s+cons[ée]quent|d[èe]s\s+lors|c{Q}est\s+pourquoi|en\s+cons[ée]quence|de\s+ce\s+fait|il\s+en\s+r[ée]sulte)\s*$"
CAUSE = r"^\s*(?:car|parce\s+qu)\b"
INTRODUCED = rf"^\s*(?:car|parce\s+que|puisque|comme|si|s{Q}{PRONOUNS}|quand|lorsqu|d[èe]s\s+que|[ée]tant\s+donn[ée]\s+que|attendu\s+que|vu\s+que)\b"
AGE = r"\b(?:avait|avaient|était|étaient)\b[^.;]{0,30}\bans\b"
THEN = r"\balors\b"
IN_THIS_CASE = r"^\s*dans\s+ce\s+cas\s*$"
ALTERNATIVE_GATE = r"\b(?:ou|soit|either|or|choix|options?|alternatives?)\b"

# Ranking cues, folded; longer ones are tried first.
RANKING_FOLDED = [
    "prime sur", "primer sur", "l'emporte sur", "lemporte sur", "emporte sur", "prevaut sur", "prevaut", "prevaut contre",
    "est prefere", "sont preferes", "est preferee", "sont preferees", "prefere a", "preferes a", "preferee a", "preferees a",
    "passe avant", "passent avant", "a la priorite", "ont la priorite", "est prioritaire", "sont prioritaires", "supplante",
    "prend le pas sur", "au detriment de", "prioritaire par rapport", "prioritaires par rapport",
]
PREFER = r"\b(?:prefer\w*|privilegi\w*)"
PLACES = "en|a|au|aux|dans|pour|sur|avec|chez|hors"
COMPARATIVE_FOLDED = PREFER + r"\s+(.{1,60}?)\s+(?:au|aux|a|plutot que)\s+(\S[^.;]{0,60})"
ELIDED_WINNER_FOLDED = PREFER + r"\s+(?:au|aux|a|plutot que)\b"
ELIDED_LOSER_FOLDED = rf"(?:\b((?:prefer\w*|privilegi\w*)\s+(.{{1,60}}?)\s+meme)\s+(?:{PLACES})\b)"
RECALL_FOLDED = rf"^\s*(?:et\s+)?meme\s+(?:{PLACES})\b"
ADVERSATIVE_FOLDED = r"^\s*(?:mais|toutefois|cependant|neanmoins|en revanche|pourtant)\b"
CONCESSION_FOLDED = rf"\bmeme\s+(?:{PLACES}|si|lorsqu|quand|apres)\b"

# Words without content, for stems and for mentions.
STEM_STOP = "les des une aux que qui pour avec sans dans sur par est sont ete etre cette cet ces son sa ses leur leurs plus moins tout tous toute".split()
MENTION_STOP = "le la les un une des du de au aux l d the a an of to and or et ou ce cette nous il elle on we it he she".split()
SPEAKER = r"(?md)^([A-ZÉÈÀÂÎÔÛ][A-ZÉÈÀÂÎÔÛ\-]+)\s*\."
