"""The word lists and patterns that define rules P13, P14 and P15."""

import re


def _words(text: str) -> frozenset[str]:
    return frozenset(text.split())


WORD = re.compile(r"[A-Za-z][A-Za-z'_.-]*")
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n\s*\n")

# --- masking
CODE_SPAN = re.compile(r"`[^`]{0,200}`")
QUOTED = re.compile(r'"[^"\n]{1,120}"')
SENTENCE_END = re.compile(r"[.!?]\s")
ABBREVIATION = re.compile(r"\b(?:[A-Za-z]|etc|vs|mr|mrs|ms|dr|prof|sr|jr|st|vol|fig|no|approx|cf|al)\.", re.I)

# --- P14
CHAIN = re.compile(r",\s+and\s+(?P<middle>[^,:;.\0]{8,120}),\s+so\b")
DASH = re.compile(r"—|–|\s--\s")
CLAUSE_CUT = re.compile(
    r":|;|—|–|\s--\s|,\s+(?:and|but|or|because|since|so|which|whose|while|although|though|if|when|unless)\b"
    r"|\b(?:because|since|while|whereas|unless|although)\b"
)
LEADING_SUBORDINATE = re.compile(r"^\s*(?:when|whenever|if|because|since|while|although|though|unless|after|before|once|where|as|until)\b[^,]*,\s*", re.I)
COPULAS = _words("is are was were isn't aren't wasn't weren't")
AUXILIARIES = COPULAS | _words(
    "has have had does do did can cannot could will would should may might must hasn't haven't doesn't don't won't can't couldn't wouldn't shouldn't"
)
VERBS = AUXILIARIES | _words(
    "be been being gets get got goes go comes come makes make takes take needs need wants want means mean sits sit runs run lives live "
    "returns return holds hold keeps keep carries carry belongs belong stays stay leaves leave fires fire reads read writes write owns own knows know"
)
REGULAR_VERB = re.compile(r"^[a-z]+(?:s|ed)$")
ADVERBS = _words("still also then never only always already now just therefore otherwise simply merely too even later first")
PREPOSITIONS = _words(
    "of in on at for with from to by under over into onto behind beside between within without inside near across through above below against per via"
)
SINGULAR = _words("it")
DETERMINER_LIKE = _words("each neither both none")
PLURAL = _words("they") | DETERMINER_LIKE
PRONOUNS = SINGULAR | PLURAL
NO_ANTECEDENT = PRONOUNS | _words(
    "this these those there what that which who nothing everything something anything nobody everybody somebody anybody everyone someone anyone one"
)
EXPLETIVE = re.compile(
    r"^it\s+(?:(?:is|was|isn't|wasn't|seems|seemed|remains|remained|becomes|became|feels|felt|looks|looked|gets|got)\s+"
    r"(?:(?:not|never|also|still|now|only|just|often|always)\s+)*(?:(?:a|an|the)\s+)?(?:[a-z'’-]+\s+){0,2}"
    r"(?:to|that|whether|which|who|what|why|where|how|when|if|for)\b"
    r"|(?:is|was|isn't|wasn't)\s+(?:(?:not|never|also|still|now|only|just)\s+)*"
    r"(?:clear|unclear|fine|safe|unsafe|hard|harder|easy|easier|cheap|cheaper|expensive|wrong|right|better|worse|best|worst|possible|impossible|"
    r"likely|unlikely|tempting|important|enough|ok|okay|true|false|obvious|rare|common|normal|unusual|useful|useless|pointless|worth|tricky|simple|"
    r"simpler|difficult|convenient|necessary|sufficient|reasonable|natural|surprising|unfortunate|odd|late|early|time)\b"
    r"|turns\s+out|seems|appears|happens|takes|matters|helps|depends|follows|suffices|makes\s+(?:no\s+)?sense|does\s+not\s+matter|doesn't\s+matter|"
    r"pays\s+to|rains)",
    re.I,
)
STOPWORDS = _words(
    "a an and are as at be but by for from has have in is it its of on or so than that the to was which with not no this there when where what would "
    "can cannot does do if into only own same still up all any how why who"
)

# --- P13
OPENERS = ("or", "and", "nor", "as well as", "rather than", "not", "but not", "plus", "including", "such as", "like", "unlike", "especially", "particularly")
COMMA_FENCE = re.compile(
    r"(?:^|[.;:!?]\s+|\(\s*)(?P<subject>[^,.;:()—–]{3,80}?),\s+"
    r"(?P<fenced>(?:" + "|".join(sorted(OPENERS, key=len, reverse=True)) + r")\s[^,.;:()—–`]{2,90}),\s+(?P<after>[A-Za-z][A-Za-z'’-]*)"
)
FINITE_AUXILIARIES = _words("is are was were has have had does do did can cannot could will would should may might must isn't aren't wasn't weren't doesn't don't hasn't haven't")
NOT_VERB_SUFFIX = re.compile(r"(?:ous|less|wards|ness|ies|ss)$")
NOT_VERBS = _words(
    "as is its this thus plus yes us always perhaps sometimes unless whereas regardless nonetheless besides afterwards indeed series species status canvas alias "
    "corpus axis basis bias bus focus bonus minus versus hundred red need seed speed feed shed bed"
)
DETERMINERS = _words(
    "a an the this these those some all every each any no its their our my your his her both few several many most such other another two three four"
)
RELATIVIZERS = _words("that which who whose whom where when")
ADVERBIAL_STARTS = frozenset(OPENERS) | _words(
    "by in on at for with from to under over after before since until if when whenever once unless while as here there otherwise today then now still also "
    "first second finally meanwhile instead sometimes often usually typically normally ideally again above below elsewhere off optional optionally note so yet but"
)
LEAST_FENCED_WORDS = 4

# --- P15
_FENCE = r"(?<![0-9])(?:\s—\s|—|\s–\s)(?![0-9])"
DASH_FENCE = re.compile(rf"(?P<open>{_FENCE})(?P<inside>(?:(?!\n\s*(?:[-*•]|\d+\.)\s)[^;:|\0—–])+?)(?P<close>{_FENCE})")
GLOSS_LINE_WORDS = 3

# --- structural tokens
CONNECTIVES = {
    "AND": r",\s+and\b", "BUT": r",\s+but\b", "OR": r",\s+or\b", "SO": r",\s+so\b", "WHICH": r",\s+wh(?:ich|ose|o)\b", "BECAUSE": r",\s+(?:because|since)\b",
    "RPAREN": r"\)", "LPAREN": r"\(", "DASH": r"\s(?:—|–|--)\s", "COLON": r":", "SEMI": r";",
}
STRUCTURE_PRONOUNS = _words("it they them each that those this these one both")
STRUCTURE_STOPWORDS = _words(
    "a an and are as at be but by for from has have in is it its of on or so than that the to was which with not no this there when where what would "
    "can cannot does do if into only own same still up"
)
