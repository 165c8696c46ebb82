"""Word lists, patterns and tables of the citation rules, in Java's regular-expression dialect.

They must find exactly what the rules define, so they are stated plainly. (?iU) makes letters, digits, word
boundaries and case Unicode-aware; END stands for "the end, or before one final line break".
"""

UF_CODES = "AC AL AP AM BA CE DF ES GO MA MT MS MG PA PB PR PE PI RJ RN RS RO RR SC SP SE TO".split()
COURTS = ["STF", "STJ", "TSE", "TST", "STM"]
UF = "(?:" + "|".join(UF_CODES) + ")"
HS = r"[ \t\u00A0]"
LS = r"[ \t\r\n\u00A0]"
END = r"(?=\n?\z)"
BREAK_OR_END = r"(?=\z|[^\w])"
LETTER = "A-Za-zÀ-ÿ"


def starts(signs: str) -> str:
    """Looks whether one of the signs, letters in either case, stands at a place: it goes before the word boundary of a pattern
    that can only start with one of them, since a Unicode-aware boundary at every place of a text costs far more than this."""
    both = "".join(sorted({c for x in signs for c in (x.lower(), x.upper())} | {y for x, more in _ALIKE.items() if x in signs for y in more}))
    return f"(?-i:(?=[{both}]))"


#: Signs beyond ASCII that (?iU) takes for a letter.
_ALIKE = {"i": "\u0130\u0131", "k": "\u212a", "s": "\u017f"}
NUMERAL = r"(?=\d)"

# --- detection: rules over the whole text -------------------------------------------------------------------------
CNJ = "(?U)" + NUMERAL + r"\b\d{3,7}\s*-\s*\d{2}\s*[.]\s*\d{4}\s*[.]\s*\d\s*[.]\s*\d{2}\s*[.]\s*\d{4}\b"
CLASSES = "AREsp|REsp|HC|Rcl|ADI|ADPF|RE|AI|MS|RR|AIRR|AP|RO"
CLASS_NAMES = r"Recurso\s+(?:Especial|Extraordin[aá]rio)|Agravo(?:\s+Regimental)?|Habeas\s+Corpus|Reclamaç[aã]o"
PROCESS = (
    rf"(?iU){starts('aehmr')}\b(?:(?:AgInt|AgRg|EDcl|ED)\s+(?:no|n[oº.]+)\s+)?(?:{CLASSES}|{CLASS_NAMES})"
    r"\s*(?:n[ºo.]?\s*)?\d[\d.\-/ ]{2,}\d(?:\s*-\s*[A-Z]{2})?"
)
SUMULA = "(?iU)" + starts("s") + r"\bS[ÚU]MULA(?:\s+VINCULANTE)?\s*(?:N[ºO.]?\s*)?\d+"
ARTICLE_TOKEN = r"\d+(?:[.]\d+)*(?:[ºo])?(?:-[A-Za-z])?"
ARTICLE_REF = rf"{starts('a')}\bart(?:igo)?[.]?{LS}+{ARTICLE_TOKEN}"
COMPLEMENT = (
    rf"(?:{LS}*,{LS}*(?:§{{1,2}}{LS}+(?:\d+(?:[ºo])?(?:-[A-Za-z])?|único)|"
    rf"parágrafo{LS}+(?:\d+(?:[ºo])?(?:-[A-Za-z])?|único)|(?:inciso{LS}+)?[IVXLCDM]+|"
    rf"alínea{LS}+['’\"]?[A-Za-z]['’\"]?|item{LS}+\d+|['’\"]?[A-Za-z]['’\"]?))*"
)
DIPLOMA_REF = (
    rf"(?:Constituiç[aã]o{LS}+(?:Federal|Fedcral|da{LS}+República(?:{LS}+Federativa{LS}+do{LS}+Brasil)?)|"
    rf"Código{LS}+(?:Civil|Eleitoral|Penal(?:{LS}+Militar)?|de{LS}+Processo{LS}+(?:Civil|Penal)|de{LS}+Defesa{LS}+do{LS}+Consumidor)|"
    rf"Consolidação{LS}+das{LS}+Leis{LS}+do{LS}+Trabalho|(?:CLT|CPC|CPP|CPM|CDC|CF(?:/88)?|CC|CE)|"
    rf"Lei(?:{LS}+Complementar)?{LS}+(?:n(?:[ºo]|[.])?{LS}+)?\d+(?:[.]\d+)*{LS}*/{LS}*\d{{4}}|"
    rf"LC{LS}+(?:n(?:[ºo]|[.])?{LS}+)?\d+{LS}*/{LS}*\d{{4}})"
)
CONNECTOR = rf"{LS}*,?{LS}*(?:do|da|de){LS}+"
LAW_WITH_DIPLOMA = "(?iU)" + ARTICLE_REF + COMPLEMENT + CONNECTOR + DIPLOMA_REF
ARTICLE_ONLY = "(?iU)" + ARTICLE_REF
VAGUE_LAW = rf"(?iU){starts('a')}\bartigo{LS}+correspondente{CONNECTOR}{DIPLOMA_REF}"
LEFT_DIPLOMA = (
    rf"(?iU){starts('cnp')}(?:nos{LS}+termos|conforme{LS}+o{LS}+disposto|previsto){LS}+(?:do|da|no|na){LS}+"
    rf"({DIPLOMA_REF}{LS}*,?{LS}*(?:em{LS}+seu{LS}+)?{ARTICLE_REF}{COMPLEMENT})"
)
COURT_CONTEXT = "(?iU)" + starts("st") + r"\b(?:STF|STJ|TSE|TST|STM)\b[^\n]{0,100}\b(?:20\d{2}|Relator|Relatora)\b"
UF_SUFFIX = rf"(?:{HS}*(?:[-/]\s*|\(\s*|{HS}+){UF}(?:\s*\))?)?"
UF_SUFFIX_HS = rf"(?:{HS}*(?:[-/]{HS}*|\({HS}*|{HS}+){UF}(?:{HS}*\))?)?"
OTHER_PROCESS = rf"(?iU){starts('ar')}\b(?:RHC|RMS|AR)\s*(?:n[ºo.]?\s*)?{HS}*(?:\n{HS}*)?\d[\d.\-/ \t\u00A0]*\d{UF_SUFFIX}{BREAK_OR_END}"
DOTTED_CLASS = (
    rf"(?iU){starts('aehr')}\b(?:(?:AgInt|AgRg|EDcl|ED){HS}+(?:no|nos|na|nas){HS}+)*(?:Rec{HS}*[.]{HS}*Esp{HS}*[.]|H{HS}*[.]{HS}*C{HS}*[.]){HS}*"
    rf"n(?:[º°.]|o)?{HS}*(?:\n{HS}*)?\d(?:[\d.\-/ \t\u00A0]*\d)?{UF_SUFFIX_HS}\b"
)
STANDALONE_MODIFIER = rf"(?iU){starts('ae')}\b(?:AgInt|AgRg|EDcl|ED)\s+n(?:[º°.]|o)?{HS}+(\d[\d.\-/ \t\u00A0]*\d){UF_SUFFIX}{BREAK_OR_END}"
COMPOUND_TITLE = (
    rf"(?iU){starts('a')}\bAgravo{LS}+Interno{LS}+n(?:a|o){LS}+Suspens[aã]o{LS}+de{LS}+(?:Liminar(?:{LS}+e{LS}+de{LS}+Senten[cç]a|)|Seguran[cç]a){LS}*"
    rf"n(?:[º°.]|o)?{LS}*(?:\n{HS}*)?\d[\d.\-/ \t\u00A0]*\d{UF_SUFFIX}{BREAK_OR_END}"
)
DECISION = "(?iU)" + starts("ajpr") + r"\b(?:Agravo\s+em\s+Recurso\s+Especial|Agravo\s+em\s+REsp|Recurso\s+em\s+Habeas\s+Corpus|RHC|Reclamação|Rcl|acórdão|julgado|precedente)\b"
DECISION_COURT = (
    r"(?iU)\A(\s*(?:do|da)?\s*)\b(?:STF|STJ|TSE|TST|STM|Supremo Tribunal Federal|Superior Tribunal de Justiça|"
    r"Tribunal Superior Eleitoral|Tribunal Superior do Trabalho|Superior Tribunal Militar)\b"
)
DECISION_YEAR = r"(?iU)\b(?:de|em)\s+(?:19\d{2}|20\d{2})\b|\b(?:julgado|proferido|profcrido)\s+(?:em\s+)?(?:19\d{2}|20\d{2})\b"
RELATOR_MARK = r"(?iU)\b(?:Rel\.?(?:\s*(?:Min\.?|Ministro|Ministra))?|(?:pela|sob|da)\s+relatoria\s+d(?:e|a|c))\s+"
RELATOR_NAME = rf"(?U)\A[A-ZÀ-Ý][{LETTER}'’-]*(?:[ \t\r\n]+[A-ZÀ-Ý][{LETTER}'’-]*){{1,5}}"
SENTENCE_BREAK = r"(?<!Rel)(?<!Min)[.!?]"
RCL_YEAR = (
    "(?iU)" + starts("r") + r"\b(?:Rcl|Reclamaç[aã]o)[ \t\r\n]+(?:de|em)[ \t\r\n]+(?:19\d{2}|20\d{2})[ \t\r\n]*,?[ \t\r\n]*"
    r"(?:Rel\.?(?:[ \t\r\n]+(?:Min\.?|Ministro|Ministra))?|(?:pela|sob|da)[ \t\r\n]+relatoria[ \t\r\n]+d(?:e|a|c))"
    rf"[ \t\r\n]+(?-i:[A-ZÀ-Ý][{LETTER}'’-]*(?:[ \t\r\n]+(?:[A-ZÀ-Ý][{LETTER}'’-]*|de|da|do|dos|das)){{1,5}})"
)
PARAGRAPH = r"(?:\r\n|\n)[ \t]*(?:\r\n|\n)"
DEGRADED_BODY = "(?U)" + NUMERAL + r"(?<!\w)\d[\d .\-\t\n]{18,80}\d(?=\s*(?:[./(),;:!?]|[A-Za-zÀ-ÿ]|\n?\z))"
CANONICAL_CNJ = r"^\d{7}-\d{2}\.\d{4}\.\d\.\d{2}\.\d{4}\z"
DEGRADED_MODIFIER = "(?:AgInt|AgRg|AgR|EDcl|ED)"
DEGRADED_MARKER = (
    rf"(?iU)(?<!\w)(?:{DEGRADED_MODIFIER}(?:{HS}+(?:no|nos|na|nas|em){HS}+|{HS}*-{HS}*))*"
    rf"(?:(?:AREsp|REsp|AgInt|AgRg|EDcl|HC|RHC|RMS|AR|Rcl|ADI|ADPF|RE|AI|MS|RR|AIRR|AP|RO|Agravo(?:{HS}+Regimental)?|"
    rf"Recurso{HS}+Especial(?:{HS}+Eleitoral)?|Recurso{HS}+Extraordin[aá]rio|Habeas{HS}+Corpus|Reclamaç[aã]o)|(?:REspe[.]?|Ag[.]{HS}*Int[.]))"
    rf"{HS}*(?:(?:n(?:[º°.o]|o)?){HS}*)?{END}"
)
DEGRADED_UF = rf"(?iU)\A\s*(?:/|\()\s*{UF}\s*\)?(?![{LETTER}])"
CHAIN = r"(?:TST-(?:ED|E|RR)(?:-(?:ED|E|RR)){0,3}|(?:ED|E|RR)(?:-(?:ED|E|RR)){1,4})"
CHAIN_NUMBER = r"\d{1,7}-\d{2}[.]\d{4}[.]\d[.]\d{2}[.]\d{4}"
COMPOUND_CHAIN = rf"(?iU){starts('ert')}(?<![A-Za-z0-9À-ÿ]-)(?<!\w){CHAIN}-{CHAIN_NUMBER}(?!\w)"

# --- detection: what may stand beside a span -----------------------------------------------------------------------
PROCESS_UF_TAIL = rf"(?U)\A{HS}*(?:[-/]{HS}*|\({HS}*|{HS}+){UF}(?:{HS}*\))?\b"
OCR_TAIL = rf"(?iU)\A([OIlS]\d(?:[\d.\-/ \t\u00A0OIlS]*\d)?{UF_SUFFIX_HS})\b"
CNJ_PREFIX = (
    rf"(?iU)(?<!\w)(?:Recurso{HS}+Especial{HS}+Eleitoral|Agravo{HS}+Regimental{HS}+no{HS}+Agravo{HS}+de{HS}+Instrumento)"
    rf"{HS}+n(?:[º°.]|o)?{HS}*{END}"
)
PROCESS_PREFIX = (
    rf"(?iU)(?:(?<!\w)(?:(?:Embargos?{HS}+de{HS}+Declaraç[aã]o|EDcl|Agravo{HS}+Interno|AgInt|Agravo{HS}+Regimental|AgRg){HS}+(?:no|nos|na|nas|em){HS}+"
    rf"|Agravo{HS}+em{HS}+)+|(?:(?:Primeiro|Segundo|Terceiro|Quarto|Quinto){HS}+)?AG[.]?{HS}*REG[.]?{HS}+n(?:o|a){HS}+){END}"
)

# --- detection: families ---------------------------------------------------------------------------------------------
FAMILY_ARTICLE = "(?iU)" + starts("ai§") + r"\b(?:art(?:igo)?[.]?\s*\d+|§\s*\d+|inciso\s+[IVXLCDM]+)"
FAMILY_DIPLOMA = (
    "(?iU)" + starts("cl") + r"\b(?:Constituiç[aã]o|C[oó]digo|Lei(?: Complementar)?\s*(?:n[ºo.]?\s*)?\d+|"
    r"CLT|CPC|CPP|CC|CDC|CPM|CF(?:/88)?|CE|LC\s*(?:n[ºo.]?\s*)?\d+\s*/\s*\d{4})\b"
)
FAMILY_SUMULA_WORD = "(?iU)" + starts("s") + r"\bS[ÚU]MULA\b"
FAMILY_PROCESS = (
    "(?iU)" + starts("aehmr") + r"\b(?:AREsp|REsp|AgInt|AgRg|EDcl|HC|RHC|RMS|AR|Rcl|ADI|ADPF|RE|AI|MS|RR|AIRR|AP|RO|"
    r"Agravo|Recurso Especial|Recurso Extraordinário|Habeas Corpus|Reclamação)\b"
)
FAMILY_COURT = (
    "(?iU)" + starts("st") + r"\b(?:STF|STJ|TSE|TST|STM|Supremo Tribunal Federal|Superior Tribunal de Justiça|Tribunal Superior Eleitoral|Tribunal Superior do Trabalho)\b"
)
FAMILY_YEAR = "(?U)" + starts("2") + r"\b20\d{2}\b"
FAMILY_PERSON = "(?iU)" + starts("mr") + r"Relator|Relatora|ministro|ministra"

# --- parsing -----------------------------------------------------------------------------------------------------------
COURT_NAME = (
    "(?iU)" + starts("st") + r"\b(?:STF|STJ|TSE|TST|STM|Supremo Tribunal Federal|Superior Tribunal de Justiça|"
    r"Tribunal Superior Eleitoral|Tribunal Superior do Trabalho|Superior Tribunal Militar)\b"
)
COURT_CODES = {
    "STF": "STF", "SUPREMO TRIBUNAL FEDERAL": "STF", "STJ": "STJ", "SUPERIOR TRIBUNAL DE JUSTIÇA": "STJ", "TSE": "TSE",
    "TRIBUNAL SUPERIOR ELEITORAL": "TSE", "TST": "TST", "TRIBUNAL SUPERIOR DO TRABALHO": "TST", "STM": "STM", "SUPERIOR TRIBUNAL MILITAR": "STM",
}
PARSE_CLASS = (
    "(?iU)" + starts("aehmr") + r"\b(?:AREsp|REsp|AgInt|AgRg|EDcl|HC|Rcl|ADI|ADPF|RE|AI|MS|RR|AIRR|AP|RO|Agravo|Recurso Especial|Recurso Extraordinário|"
    r"Habeas Corpus|Reclamação)\b"
)
#: Group 1 class, group 2 number.
NUMBERED_CASE = (
    rf"(?iU){starts('aehmr')}((?:(?:AgInt|AgRg|EDcl|ED)\s+(?:no|n[oº.]+)\s+)?(?:{CLASSES}|{CLASS_NAMES}))\s*(?:n[ºo.]?\s*)?(\d[\d.\-/ ]{{2,}}\d)(?:\s*[-/]\s*[A-Z]{{2}})?"
)
RECURSO_CLASS = "(?iU)" + starts("ar") + r"(?:AREsp|REsp|Rec[.]?\s*Esp[.]?|Recurso\s+Especial)"
MARKER_SAME_LINE = rf"(?iU){starts('n')}(?<![A-Za-z])n(?:o|[º°.]|o)?{HS}*(\d(?:[\d.\-/ \t\u00A0]*\d)?)"
MARKER_ANY_LINE = "(?iU)" + starts("n") + r"(?<![A-Za-z])n(?:o|[º°.]|o)?\s*(\d(?:[\d.\-/ \n]*\d)?)"
MARKER_BROKEN = rf"\A[.\-]*{HS}*\n"
#: Group 1 raw tail, group 2 state.
UF_TAIL = rf"(?U)\A\s*((?:[-/]\s*|\(\s*|{HS}+)({UF})(?:\s*\))?)\b"
OCR_TOKEN = r"(?iU)\d(?:[\d.\-/\s]*[OIlS])(?:[\d.\-/\sOIlS]*\d)"
SUMULA_NUMBER = "(?iU)" + starts("s") + r"\bS[ÚU]MULA(?:\s+VINCULANTE)?\s*(?:N[ºO.]?\s*)?(\d+)"
SUMULA_CORPUS = r"(?iU)S[ÚU]MULA(?:\s+VINCULANTE)?\s+(\d+)"
PARSE_ARTICLE = "(?iU)" + starts("a") + r"\b(?:art(?:igo)?s?[.]?\s*)(\d+(?:[.]\d+)*(?:[ºo])?(?:-[A-Za-z])?)"
PARSE_PARAGRAPH = (
    "(?iU)" + starts("p§") + r"(§{1,2}\s*(\d+(?:[ºo])?(?:-[A-Za-z])?|único)|parágrafo\s+(\d+(?:[ºo])?(?:-[A-Za-z])?|único))"
)
PARSE_INCISO = r"(?iU),\s*(?:inciso\s+)?([IVXLCDM]+)\b"
PARSE_ALINEA = "(?iU)" + starts("a") + r"\balínea\s+['’\"]?([A-Za-z])['’\"]?"
PARSE_ALINEA_QUOTED = r"(?iU),\s*['’\"]([A-Za-z])['’\"]"
PARSE_ALINEA_BARE = r"(?U),\s*([A-Ha-h])\b"
PARSE_DIPLOMA = (
    "(?iU)" + starts("cl") + r"\b(?:Constituiç[aã]o\s+(?:Federal|Fedcral|da\s+República(?:\s+Federativa\s+do\s+Brasil)?)|"
    r"C[oó]digo\s+(?:Civil|Eleitoral|Penal(?:\s+Militar)?|de\s+Processo\s+(?:Civil|Penal)|de\s+Defesa\s+do\s+Consumidor)|"
    r"Consolidação\s+das\s+Leis\s+do\s+Trabalho|Lei(?:\s+Complementar)?\s*(?:n(?:[ºo]|[.])?\s*)?\d+(?:[.]\d+)*\s*/\s*\d{4}|"
    r"LC\s*(?:n(?:[ºo]|[.])?\s*)?\d+\s*/\s*\d{4}|CLT|CPC|CPP|CC|CDC|CPM|CF(?:/88)?|CE)\b"
)
TRUNCATED_DIPLOMA = "(?iU)" + starts("c") + r"\bC[oó]digo\s+de\s+De\b"
RIGHT_LINK = (
    r"(?iU)\A\s*(?:,\s*(?:§{1,2}\s*(?:\d+(?:[ºo])?(?:-[A-Za-z])?|único)|parágrafo\s+(?:\d+(?:[ºo])?(?:-[A-Za-z])?|único)|"
    r"(?:inciso\s+)?[IVXLCDM]+|alínea\s+['’\"]?[A-Za-z]['’\"]?|item\s+\d+|['’\"]?[A-Za-z]['’\"]?))*\s*,?\s*(?:do|da|de)\s*\z"
)
LEFT_LINK = r"(?iU)\A\s*,?\s*(?:em\s+seu\s+)?\z"
LAW_NUMBER = "(?iU)" + starts("l") + r"\bLei(?: Complementar)?\s*(?:n[ºo.]?\s*)?(\d+[./-]?\d*)(?:/(\d{4}))?"
RELATOR = rf"(?iU){starts('r')}\b(?:Rel\.?|Relator(?:a)?)\s*(?:Min\.?|Ministra|Ministro|Des\.?)?\s*[A-Z][{LETTER} .-]{{2,}}"
YEAR = "(?U)" + starts("12") + r"\b(19\d{2}|20\d{2})\b"
#: Group 1 court, group 2 class.
CNJ_CONTEXT = rf"(?iU)(\b(?:STF|STJ|TSE|TST|STM)\b)\s*[-:]\s*([{LETTER}][A-Za-z0-9À-ÿ.-]*)\s*[-:]?\s*{END}"
CHAIN_PARTS = rf"(?iU)\A({CHAIN})-({CHAIN_NUMBER})\z"
PHRASES = (
    "(?iU)" + starts("ahmr") + r"(?:RECURSO\s+ESPECIAL\s+ELEITORAL|RECURSO\s+ESPECIAL|RECURSO\s+EXTRAORDIN[ÁA]RIO|HABEAS\s+CORPUS|RECLAMA[ÇC][AÃ]O|"
    r"APELA[ÇC][AÃ]O|AGRAVO\s+INTERNO|AGRAVO\s+REGIMENTAL|MANDADO\s+DE\s+SEGURAN[ÇC]A)"
)
CLASS_TOKENS = "(?iU)" + starts("aehmr") + r"\b(?:AREsp|REsp|AgInt|AgRg|EDcl|HC|Rcl|ADI|ADPF|RE|AI|MS|RR|AIRR|AP|RO)\b"
CLASS_BLOCK = r"[A-ZÀ-ÿ][A-Z0-9À-ÿ]*"
TST_PREFIX = rf"(?U)(?:TST\s*-\s*)?({CLASS_BLOCK}(?:\s*-\s*{CLASS_BLOCK})*)\s*-\s*(?=\d)"

# --- diplomas ------------------------------------------------------------------------------------------------------------
NAMESPACES = ["CE", "CPM", "CDC", "CF", "CLT", "CPP", "CC", "LC:64:1990", "CPC", "LEI:9504:1997", "LEI:13467:2017"]
#: Names of diplomas as fold() gives them: fixed values.
SAFE_ALIASES = {
    "CONSTITUICAO FEDERAL": "CF", "CONSTITUICAO DA REPUBLICA": "CF", "CONSTITUICAO DA REPUBLICA FEDERATIVA DO BRASIL": "CF", "CLT": "CLT",
    "CONSOLIDACAO DAS LEIS DO TRABALHO": "CLT", "CPC": "CPC", "CODIGO DE PROCESSO CIVIL": "CPC", "CODIGO DE PROCESSO CIVIL DE 2015": "CPC",
    "LEI N 13.105/2015": "CPC", "CPP": "CPP", "CODIGO DE PROCESSO PENAL": "CPP", "CPM": "CPM", "CODIGO PENAL MILITAR": "CPM", "CODIGO CIVIL": "CC",
    "CDC": "CDC", "CODIGO DE DEFESA DO CONSUMIDOR": "CDC", "CODIGO ELEITORAL": "CE", "LEI N 4.737/1965": "CE", "LEI COMPLEMENTAR N 64/1990": "LC:64:1990",
    "LC N 64/1990": "LC:64:1990", "LC 64/1990": "LC:64:1990",
}
#: The full names among them in which one damaged letter is repaired.
LONG_NAMES = [
    "CONSTITUICAO FEDERAL", "CONSTITUICAO DA REPUBLICA", "CONSTITUICAO DA REPUBLICA FEDERATIVA DO BRASIL", "CONSOLIDACAO DAS LEIS DO TRABALHO",
    "CODIGO DE PROCESSO CIVIL", "CODIGO DE PROCESSO PENAL", "CODIGO PENAL MILITAR", "CODIGO DE DEFESA DO CONSUMIDOR", "CODIGO ELEITORAL",
]
GUARDED_ALIASES = {"CF": "CF", "CF/88": "CF", "CC": "CC", "CE": "CE"}
STATUTES = {
    "LEI:13105:2015": "CPC", "LEI:4737:1965": "CE", "LC:64:1990": "LC:64:1990", "LEI:5452:1943": "CLT", "LEI:3689:1941": "CPP",
    "LEI:1001:1969": "CPM", "LEI:8078:1990": "CDC", "LEI:10406:2002": "CC",
}
LAW_IDENTITY = r"^LEI( COMPLEMENTAR)?(?: N)? (\d+(?:[.]\d+)*)/(\d{4})\z"
HEADER_ARTICLE = r"(?iU)\A\s*(?:ART(?:IGO)?)[.]?\s*(\d+(?:[.]\d+)*(?:[ºªO])?(?:-[A-Z])?)\b"
HEADER_STATUTE = r"(?iU)(DECRETO-?LEI|LEI\s+COMPLEMENTAR|LEI)\s*(?:N[ºO.]?\s*)?(\d+(?:[.]\d+)*).*?(\d{4})"
HEADER_NAMES = [
    ("CONSTITUICAO FEDERAL", "CF"), ("CONSTITUICAO DA REPUBLICA", "CF"), ("CONSOLIDACAO DAS LEIS DO TRABALHO", "CLT"), ("CODIGO DE PROCESSO PENAL", "CPP"),
    ("CODIGO PENAL MILITAR", "CPM"), ("CODIGO DE DEFESA DO CONSUMIDOR", "CDC"), ("CODIGO CIVIL", "CC"), ("CODIGO ELEITORAL", "CE"), ("CODIGO DE PROCESSO CIVIL", "CPC"),
]

# --- arbitration ---------------------------------------------------------------------------------------------------------
NUMBER_TOKEN = NUMERAL + r"(?<!\w)\d(?:[\d.\-/\s]*\d)(?!\w)"
SEGMENT_COURT = {"5": "TST", "6": "TSE", "7": "STM"}
HEADER_LAYOUT = r"(?iU)\b(?:poder judici[aá]rio|supremo tribunal|tribunal superior|cabe[cç]alho|identifica[cç][aã]o)\b"
PARTY_TERMS = r"(?iU)\b(?:recorrente|recorrido|agravante|agravado|impetrante|paciente|autor|r[ée]u|reclamante|reclamada)\b"
HISTORY_TERMS = (
    r"(?iU)\b(?:origem|autos? de origem|hist[oó]rico|andamento|tr[âa]mite|distribu[ií]d[oa]|remetid[oa]|instaura[cç][aã]o|j[aá] sentenciad[oa])\b"
)
PROCESS_NEAR = (
    r"(?iU)\b(?:processos?|autos?|feitos?|inquéritos?|a(?:ç|c)[aã](?:o|oes|ões)?\s+pen(?:al|ais)|recursos?)\s*(?:n[ºo°.]?|número)?\s*"
)
ARGUMENT = (
    r"(?iU)\b(?:precedente|jurisprud[êe]ncia|ratio decidendi|tese|conforme|confira-se|como\s+j[aá]\s+(?:se\s+)?(?:decidiu|reconheceu)|"
    r"entendimento|orienta[cç][aã]o|firmou|aplica-se|invoca-se|corrobora)\b"
)
CITATION_VERB = r"(?iU)\b(?:cita|citado|citada|invoca|invocado|conforme|confira-se|reconheceu|decidiu|firmou|aplicou|transcreve)\b"
GUARD_CLASS = (
    r"(?iU)\b(?:apela[cç][aã]o|apela[cç][õo]es|recursos?|agravos?|habeas\s+corpus|mandado\s+de\s+seguran[cç]a|reclama[cç][aã]o|embargos?)\b"
)
GUARD_SOURCE = r"(?iU)\b(?:dje|di[aá]rio\s+de\s+justi[cç]a|relator(?:a)?|rel\.|ementa)\b"
GUARD_FOUNDATION = r"(?iU)\b(?:no\s+mesmo\s+sentido|conforme|entendimento|orienta[cç][aã]o|jurisprud[êe]ncia|precedentes?)\b"
GUARD_QUOTE = "[\"“”]"
H4_WINDOW, G4_WINDOW = 120, 1600

# --- rulings: where their own number stands --------------------------------------------------------------------------------
RELATOR_WORD = r"(?iU)\bRELATORA?\b"
STF_ANCHOR = r"(?iU)\b(?:PRIMEIRA|SEGUNDA|TERCEIRA|QUARTA|QUINTA|SEXTA) TURMA\b|\bPLEN[ÁA]RIO\b"
STF_NUMBER = r"(?U)(?<!\d)\d{1,3}(?:\.\d{3})+(?!\d)"
STJ_TITLE = (
    r"(?iU)\b(?:(?:RECURSO|AGRAVO|AGINT|HABEAS|EMBARGOS|MANDADO|AÇÃO|CONFLITO|CAUTELAR|QO|RECLAMAÇÃO|SUSPENSÃO|PETIÇÃO|EDCL)[^.;]{0,140}?)"
    r"\s+N[ºO.]\s*(\d{1,3}(?:\.\d{3})*|\d+)\s*-\s*[A-Z]{2}\b"
)
TST_ANCHOR = r"(?iU)VISTOS,? RELATADOS E DISCUTIDOS ESTES AUTOS"
TST_STOP = r"(?iU),\s*EM QUE\b"
TST_NUMBER = (
    r"(?iU)(?:TST\s*-\s*)?[A-Z][A-Z0-9]*(?:\s*-\s*[A-Z][A-Z0-9]*)*\s*-\s*\d{1,7}\s*-\s*\d{2}\s*[. ]\s*\d{4}\s*[. ]\s*\d\s*[. ]\s*\d{2}\s*[. ]\s*\d{4}"
)
STM_TITLE = (
    r"(?iU)\b(?:(?:APELA[ÇC][AÃ]O|AGRAVO|EMBARGOS|HABEAS CORPUS|CONFLITO|RECURSO|A[ÇC][AÃ]O|CORREI[ÇC][AÃ]O|REPRESENTA[ÇC][AÃ]O|RECLAMA[ÇC][AÃ]O)[^,]{0,140}?)"
    r"\s+N[ºO.]\s*(\d{3,7}\s*-\s*\d{2}\s*[. ]\s*\d{4}\s*[. ]\s*\d\s*[. ]\s*\d{2}\s*[. ]\s*\d{4})(?:\s*/\s*[A-Z]{2})?"
)
GAP = r"[\s\W_]*"
TSE_INSTITUTION = rf"(?iU)TR(?:IBUNAL|E3UNAL){GAP}(?:SUPER(?:IOR|POR){GAP})?ELEITOR(?:A{GAP}L)"
TSE_ACORDAO = rf"(?iU)AC(?:Ó|O|€){GAP}RD(?:Ã|A)?{GAP}O"
TSE_RELATOR = r"(?iU)\b(?:RELATOR|REIATOR)\b"
TSE_TITLE = (
    r"(?iU)\b(?:RECURSO|AGRAVO|EMBARGOS|AÇÃO|ACAO|PETIÇÃO|PETICAO|MANDADO|HABEAS|LISTA|REPRESENTAÇÃO|REPRESENTACAO|RECLAMAÇÃO|RECLAMACAO)"
)
TSE_LABEL = r"(?iU)\b(?:REspe|AgR-REspe|ED-AgR-AR|AgR-RO|RECURSO ESPECIAL ELEITORAL|AGRAVO REGIMENTAL|EMBARGOS)\b"
TSE_LEGACY = r"(?iU)\bN\s*(?:[ºO‚.]|o)?\s*(\d{1,3}(?:[.,]\d{3})+)\b"
_NOISE = r"[\s.,;:_€‚ƒ„…†‡‰]*"
TSE_NUMBER = (
    rf"(?iU)(?<!\d)\d(?:{_NOISE}\d){{0,6}}\s*[-–—]\s*\d(?:{_NOISE}\d)\s*{_NOISE}\d(?:{_NOISE}\d){{3}}\s*{_NOISE}\d\s*{_NOISE}\d(?:{_NOISE}\d)\s*"
    rf"{_NOISE}\d(?:{_NOISE}\d){{3}}(?!\d)"
)
TSE_PLAIN = r"(?iU)\A\d{1,7}-\d{2}\.\d{4}\.\d\.\d{2}\.\d{4}(?:/[A-Z]{2})?\z"
