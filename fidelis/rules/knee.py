"""Knee magnetic resonance rules in Spanish. All patterns, terms and phrases below are fixed values."""

from __future__ import annotations

from fidelis.rules import Finding, Term, near

# Concepts that several findings name.
ACL = r"(?:LCA|ligamento\s+cruzado\s+anterior)"
MCL = r"(?:LCM|LCI|ligamento\s+colateral\s+(?:interno|medial)|ligamento\s+del\s+lado\s+interno)"
MENISCUS = r"menisco\s+(?:interno|medial)"
FLUID = r"(?:derrame|l[ií]quido)"

# The findings.
FINDINGS: list[Finding] = [
    Finding(
        "Rotura completa del LCA",
        "completa",
        [rf"\b{ACL}\b", r"\bligamento\s+cruzado\b", r"\bcruzado\s+anterior\b"],
        [
            rf"\brotura\s+completa\s+(?:del\s+)?{ACL}",
            near(ACL, r"\brotura\s+completa\b"),
            near(ACL, r"roto\s+por\s+completo"),
            near(ACL, r"completamente\s+rot[oa]"),
            rf"\breconstrucci[oó]n\s+del\s+{ACL}",
        ],
        [
            near(ACL, r"\bparcial(?:mente)?\b"),
            near(ACL, r"\b(?:leve|m[ií]nim[oa])\b"),
            near(ACL, r"\b(?:intact[oa]|conservad[oa])\b"),
            near(ACL, r"\bdistensi[oó]n\b"),
        ],
        words=["lca", "cruzado"],
    ),
    Finding(
        "Rotura del cuerno posterior del menisco interno",
        "grado III",
        [
            rf"\b{MENISCUS}\b",
            r"\brotura\s+(?:en\s+(?:el|un)\s+)?menisco\b",
            r"\bmenisco\s+(?:roto|dañado|lesionado|afectado)\b",
            r"\bmenisco\b[^.]{0,30}\b(?:roto|dañado|rotura)\b",
        ],
        [
            near(MENISCUS, r"\brotura\b"),
            near(MENISCUS, r"\b(?:grado\s+III|complej[ao])\b"),
            r"\btratamiento\s+(?:del\s+)?menisco\s+interno\b",
            r"\btratamiento\s+(?:del\s+)?menisco\b",
        ],
        [near(MENISCUS, r"\b(?:intact[oa]|sin\s+rotura)\b"), near(MENISCUS, r"\bpeque[nñ][ao]\s+(?:fisura|molestia)\b")],
        severity_optional=True,
        words=["menisco"],
    ),
    Finding(
        "Edema oseo en patron pivot-shift",
        "postraumatico",
        [
            r"\bedema\s+[oó]seo\b",
            r"\binflamaci[oó]n\s+interna\s+del\s+hueso\b",
            r"\bcontusi[oó]n\s+[oó]sea\b",
            r"\bcontusi[oó]n\b",
            r"\blesi[oó]n\s+por\s+golpe\b",
            r"\bgolpe\b[^.]{0,50}\bhuesos?\b",
            r"\bhuesos?\b[^.]{0,50}\bgolpe\b",
            r"\bhuesos?\s+(?:dañados?|afectados?|contusionados?)\b",
            r"\binflamaci[oó]n\b[^.]{0,40}\bhuesos?\b",
        ],
        [r"\bedema\s+[oó]seo\b", r"\binflamaci[oó]n\s+interna\s+del\s+hueso\b"],
        [r"\bhuesos?\s+(?:est[aá]n\s+)?(?:bien|sanos|intactos)\b"],
        words=["edema", "hueso", "contusi", "golpe"],
    ),
    Finding(
        "Distension grado I del LCM",
        "grado I (leve)",
        [rf"\b{MCL}\b", r"\bcolateral\s+(?:interno|medial)\b", r"\bligamento\s+(?:del\s+lado\s+)?interno\b"],
        [
            near(MCL, r"\b(?:distensi[oó]n|estirad[oa]|grado\s+I|leve|inflamad[oa])\b"),
            near(MCL, r"\bno\s+est[aá]\s+roto\b"),
            near(MCL, r"\bdaño\s+leve\b"),
            near(MCL, r"\bsin\s+rotura\b"),
        ],
        [near(MCL, r"(?<!sin\s)(?<!no\s)(?:rotura\s+completa|completamente\s+rot[oa]|grado\s+(?:II|III))\b")],
        severity_optional=True,
        words=["lcm", "lci", "colateral", "ligamento"],
    ),
    Finding(
        "Condromalacia grado II en condilo femoral interno",
        "grado II",
        [
            r"\bcondromalacia\b",
            r"\b(?:desgaste|deterioro|adelgazamiento)\b[^.]{0,40}\bcart[ií]lago\b",
            r"\bcart[ií]lago\b[^.]{0,40}\b(?:desgaste|deterioro|irregularidad)\b",
            r"\bablandamiento\s+del\s+cart[ií]lago\b",
            r"\bcart[ií]lago\b[^.]{0,40}\b(?:ablandado|dañado|desgastado)\b",
        ],
        [r"\bcondromalacia\s+grado\s+II\b", near(r"cart[ií]lago", r"\bgrado\s+II\b"), near(r"(?:desgaste|deterioro)", r"\bsuperficial\b")],
        [r"\bcart[ií]lago\s+(?:est[aá]\s+)?(?:intact[oa]|conservad[oa]|preservad[oa])\b"],
        severity_optional=True,
        words=["condromalacia", "cartilago", "cartílago", "desgaste", "deterioro"],
    ),
    Finding(
        "Derrame articular moderado",
        "moderado",
        [
            r"\bderrame\b",
            r"\bl[ií]quido\b[^.]{0,30}\barticulaci[oó]n\b",
            r"\bacumulaci[oó]n\s+de\s+l[ií]quido\b",
            r"\bagua\b[^.]{0,30}\brodilla\b",
        ],
        [near(FLUID, r"\bmoderad[oa]\b", window=60)],
        [r"\bsin\s+derrame\b", near(FLUID, r"\b(?:m[ií]nim[oa]|escas[oa])\b", window=40)],
        words=["derrame", "liquido", "líquido", "agua"],
    ),
    Finding(
        "Recomendacion de valoracion por traumatologia",
        "—",
        [
            r"\b(?:traumat[oó]log[oa]|traumatolog[ií]a|cirug[ií]a\s+ortop[eé]dica)\b",
            r"\btraumatol[oó]gic[ao]\b",
            r"\b(?:ortop[eé]dic[ao]|ortopedista)\b",
            r"\bespecialista\b[^.]{0,40}\b(?:rodilla|cirug[ií]a|tratamiento)\b",
        ],
        [r"\breconstrucci[oó]n\s+del\s+(?:LCA|ligamento\s+cruzado\s+anterior)\b", r"\btratamiento\s+(?:del\s+)?menisco\b"],
        [r"\bno\s+(?:requiere|necesita)\s+(?:cirug[ií]a|operaci[oó]n)\b", r"\b(?:basta|suficiente)\s+con\s+(?:reposo|fisioterapia)\b"],
        words=["traumat", "ortop", "especialista", "reconstrucci", "menisco", "requiere", "necesita", "reposo", "fisioterapia"],
    ),
]

# The lexicon.
LEXICON: list[Term] = [
    Term("rodilla", "ANATOMIA", [r"\brodilla\b"], ["rodilla"]),
    Term("menisco_interno", "ANATOMIA", [r"\bmenisco\s+(?:interno|medial)\b"], ["menisco"]),
    Term("menisco_externo", "ANATOMIA", [r"\bmenisco\s+(?:externo|lateral)\b"], ["menisco"]),
    Term("LCA", "ANATOMIA", [r"\bLCA\b", r"\bligamento\s+cruzado\s+anterior\b"], ["lca", "cruzado"]),
    Term("LCP", "ANATOMIA", [r"\bLCP\b", r"\bligamento\s+cruzado\s+posterior\b"], ["lcp", "cruzado"]),
    Term("LCM", "ANATOMIA", [r"\b(?:LCM|LCI)\b", r"\bligamento\s+colateral\s+(?:interno|medial)\b"], ["lcm", "lci", "colateral"]),
    Term("cartilago", "ANATOMIA", [r"\bcart[ií]lago\b"], ["cartilago", "cartílago"]),
    Term("hueso", "ANATOMIA", [r"\bhuesos?\b"], ["hueso"]),
    Term("articulacion", "ANATOMIA", [r"\barticulaci[oó]n\b"], ["articulaci"]),
    Term("rotula", "ANATOMIA", [r"\br[oó]tula\b"], ["rotula", "rótula"]),
    Term("condilo_femoral", "ANATOMIA", [r"\bc[oó]ndilo\s+femoral\b"], ["femoral"]),
    Term("meseta_tibial", "ANATOMIA", [r"\bmeseta\s+tibial\b"], ["meseta"]),
    Term("rotura", "HALLAZGO", [r"\brotura\b", r"\brot[oa]\b", r"\bdiscontinuidad\b"], ["rotura", r"\broto\b", r"\brota\b", "discontinuidad"]),
    Term("fractura", "HALLAZGO", [r"\bfractura\b"], ["fractura"]),
    Term("fisura", "HALLAZGO", [r"\bfisura\b"], ["fisura"]),
    Term("distension", "HALLAZGO", [r"\bdistensi[oó]n\b", r"\bestirad[oa]\b"], ["distensi", "estirad"]),
    Term("edema_oseo", "HALLAZGO", [r"\bedema\s+[oó]seo\b", r"\binflamaci[oó]n\s+interna\s+del\s+hueso\b"], ["edema", "hueso"]),
    Term("derrame", "HALLAZGO", [r"\bderrame\b"], ["derrame"]),
    Term("condromalacia", "HALLAZGO", [r"\bcondromalacia\b", r"\bdesgaste\s+(?:focal\s+|superficial\s+)?(?:del\s+)?cart[ií]lago\b"], ["condromalacia", "desgaste"]),
    Term("inflamacion", "HALLAZGO", [r"\binflamaci[oó]n\b"], ["inflamaci"]),
    Term("completa", "SEVERIDAD", [r"\bcomplet[oa]s?\b", r"\bpor\s+completo\b"], [r"\bcomplet"]),
    Term("parcial", "SEVERIDAD", [r"\bparcial(?:mente)?\b"], [r"\bparcial"]),
    Term("grado_I", "SEVERIDAD", [r"\bgrado\s+I(?!I)\b"], ["grado"]),
    Term("grado_II", "SEVERIDAD", [r"\bgrado\s+II(?!I)\b"], ["grado"]),
    Term("grado_III", "SEVERIDAD", [r"\bgrado\s+III\b"], ["grado"]),
    Term("leve", "SEVERIDAD", [r"\bleve\b"], [r"\bleve\b"]),
    Term("moderado", "SEVERIDAD", [r"\bmoderad[oa]\b"], ["moderad"]),
    Term("focal", "SEVERIDAD", [r"\bfocal\b"], [r"\bfocal\b"]),
    Term("resonancia", "PROCEDIMIENTO", [r"\bresonancia\s+magn[eé]tica\b", r"\bRM\b"], ["resonancia", r"\brm\b"]),
    Term("reconstruccion_LCA", "PROCEDIMIENTO", [r"\breconstrucci[oó]n\s+(?:del\s+)?(?:LCA|ligamento\s+cruzado\s+anterior)\b"], ["reconstrucci"]),
    Term("traumatologia", "PROCEDIMIENTO", [r"\btraumat[oó]log[oa]\b", r"\btraumatolog[ií]a\b"], ["traumat"]),
    Term("fisioterapia", "PROCEDIMIENTO", [r"\bfisioterapia\b"], ["fisioterapia"]),
    Term("reposo", "PROCEDIMIENTO", [r"\breposo\b"], ["reposo"]),
]

# Lay phrases for canonical terms.
SYNONYMS: dict[str, list[str]] = {
    "edema_oseo": ["contusión", "lesión por golpe en los huesos", "moratón interno", "hematoma óseo", "golpe en el hueso"],
    "LCA": ["ligamento cruzado", "cruzado anterior", "ligamento que cruza la rodilla"],
    "condromalacia": ["ablandamiento del cartílago", "desgaste del cartílago", "deterioro del cartílago"],
    "derrame": ["acumulación de líquido", "líquido en la articulación", "líquido articular", "agua en la rodilla"],
    "rotura": ["dañado completamente", "lesionado", "partido"],
    "menisco_interno": ["amortiguador interno"],
    "grado_III": ["rotura importante", "rotura grave", "rotura compleja", "dañado gravemente"],
    "grado_I": ["daño leve", "lesión leve", "estirado levemente"],
}

# Spanish stop words, without accents.
STOP_WORDS: list[str] = [
    "el", "la", "los", "las", "un", "una", "unos", "unas", "lo", "de", "del", "en", "a", "al", "con", "por", "para", "como", "hacia", "desde",
    "hasta", "sobre", "entre", "durante", "mediante", "segun", "ante", "tras", "bajo", "y", "e", "o", "u", "pero", "aunque", "sino", "porque", "pues",
    "que", "si", "cuando", "donde", "mientras", "tambien", "ademas", "cuyo", "cuya", "se", "le", "les", "mi", "tu", "te", "me", "nos", "os", "su",
    "sus", "es", "son", "soy", "eres", "fue", "fueron", "ser", "sera", "siendo", "sido", "esta", "estan", "estoy", "estar", "estaba", "estado", "ha",
    "han", "he", "has", "habia", "habra", "hay", "haber", "muy", "mas", "menos", "tan", "tanto", "mucho", "poco", "todo", "cada", "otro", "mismo",
    "alguno", "ya", "aun", "asi", "incluso", "luego", "entonces",
]

# Abbreviations that do not end a sentence.
ABBREVIATIONS: list[str] = ["dr.", "dra.", "sr.", "sra.", "etc.", "p.ej.", "vs."]
