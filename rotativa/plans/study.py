"""The study that the registered queries run: word lists, actors, frames, markers."""

from __future__ import annotations

from rotativa.operators.tone import Lexicon

STOPWORDS = tuple("que los las del por con una para como más sin sus ante esa ese esta este desde the and not que não com uma dos das".split())
LEXICON = Lexicon(
    positive=tuple("respaldó defendió impulsó reactivó amplió aprobado estable acompañó apoiou backed revived supported sostenible".split()),
    negative=tuple("rechazó bloqueó frenó desmintió recortó suspendió congeló cuestionó error polémico rejected froze delayed bloqueou suspendeu".split()),
    negators=tuple("no ni nunca sin tampoco nadie not never não nem".split()),
    emotions={
        "alegria": tuple("acuerdo alianza estable aprobado agreement joint".split()),
        "miedo": tuple("bloqueo urgente emergencia tense hostile amenaza".split()),
        "ira": tuple("denuncia querella marcha strike protest polémico".split()),
        "confianza": tuple("respaldó defendió backed supported compromiso".split()),
    },
    frames={
        "economia": ("presupuest", "impuest", "tarif", "financi", "tax", "budget"),
        "justicia": ("tribunal", "fiscal", "sentencia", "judicial", "court"),
        "salud": ("hospital", "sanitari", "clinic", "salud"),
        "elecciones": ("elector", "vot", "candidat", "campaña"),
    },
    subjective=tuple("cree parece opina considera think quizá lamentó error".split()),
    factual=tuple("según confirmó informó datos acordó votos confirmed said".split()),
    groups={"propios": tuple("nosotros nuestro nuestra nos".split()), "ajenos": tuple("ellos quienes otros nadie".split()), "elogio": tuple("histórico ampliada histórica".split())},
)
ACTORS = {"Tribunal": "tribunal", "Sindicato": "sindicato"}
PEOPLE = {"Alcaldía": ("alcaldía", "gobernación"), "Fiscalía": ("fiscalía",), "Congreso": ("comisión", "bancada"), "Hospital": ("hospital",)}
RELEVANT, EXCLUDED = ("tribunal", "campaña"), ("loterías",)
FURNITURE = r"^(síguenos|compart|etiquetas|temas|foto:|publicidad|lea también|relacionado|suscr|reciba)|todos los derechos reservados|cookies"
INTERFACE = r"compartir|suscr[ií]base|síguenos|boletín|cookies|comentarios|inicie sesión"
CONNECTORS = tuple("además según para desde con sin embargo hasta ahora por ante entre unas ni".split())
TOP_LEVEL = {"co": "CO", "mx": "MX", "es": "ES", "cl": "CL", "pe": "PE", "br": "BR", "uk": "GB"}
NAME_WORDS = {
    "connectors": CONNECTORS,
    "verbs": tuple("dijo agregó señaló afirmó sostuvo explicó negó".split()),
    "common": tuple("presidente alcalde senador ministra fiscal ley estado nueva".split()),
    "kept": ("m-19", "g-20"),
    "openings": tuple("de del la el los las en a con por para un una su al y que".split()),
    "signals": tuple("foto video radio presidente gobierno".split()),
}
#: Particles of surnames.
PARTICLES = ("de", "la", "del", "los", "las", "y", "san", "santa")
WALL = r"acepte? (?:las )?cookies|inicie sesión para|suscríbase para (?:seguir|continuar)|contenido exclusivo"
