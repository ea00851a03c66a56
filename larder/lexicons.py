"""Word lists and vocabularies. They decide results and are parameters wherever they are used."""

# Words that carry no content; negations are not among them.
STOPWORDS = tuple(
    """a ao aos aquela aquelas aquele aqueles aquilo as ate com como da das de dela delas dele deles depois do dos e ela
    elas ele eles em entre era eram essa essas esse esses esta estao estar estas estava estavam este estes eu foi foram
    ha isso isto ja lhe lhes mais mas me mesmo minha minhas meu meus muito na nas no nos o os ou para pela pelas pelo
    pelos por porque qual quando que quem se seja ser seu seus sua suas tambem tem tendo ter teu teus tua tuas um uma
    umas uns voce voces""".split()
)

# Irregular lemmas.
LEMMAS = {
    "adicione": "adicionar", "adicionar": "adicionar", "adicionando": "adicionar", "batatas": "batata", "cebolas": "cebola",
    "colheres": "colher", "cozinhe": "cozinhar", "cozinhar": "cozinhar", "cozinhando": "cozinhar", "dentes": "dente",
    "deixe": "deixar", "deixar": "deixar", "fatie": "fatiar", "ferva": "ferver", "ferver": "ferver", "gramas": "grama",
    "ingredientes": "ingrediente", "misture": "misturar", "misturar": "misturar", "misturando": "misturar",
    "minutos": "minuto", "pique": "picar", "porcoes": "porcao", "receitas": "receita", "refogue": "refogar",
    "refogar": "refogar", "tomates": "tomate", "xicara": "xicara", "xicaras": "xicara",
}

# Suffixes a stem loses, the first that fits.
SUFFIXES = tuple("amentos imentos adoras adores acoes icoes mente ando endo indo aria eria iria cao dor das dos ais oes res es as os s".split())

# Verbs of instructions, and their forms.
VERBS = tuple("adicionar assar bater cobrir colocar cozinhar cortar deixar despejar fatiar ferver fritar juntar levar mexer misturar picar refogar retirar servir temperar".split())
VERB_FORMS = {
    "adicione": "adicionar", "asse": "assar", "bata": "bater", "cubra": "cobrir", "coloque": "colocar", "cozinhe": "cozinhar",
    "corte": "cortar", "deixe": "deixar", "despeje": "despejar", "fatie": "fatiar", "ferva": "ferver", "frite": "fritar",
    "junte": "juntar", "leve": "levar", "mexa": "mexer", "misture": "misturar", "pique": "picar", "refogue": "refogar",
    "retire": "retirar", "sirva": "servir", "tempere": "temperar",
}
DETERMINERS = tuple("a as o os um uma uns umas".split())
PREPOSITIONS = tuple("a ate com da das de do dos em na nas no nos para por sobre".split())

# Sentiment.
NEGATIONS = tuple("nao nunca jamais sem".split())
INTENSIFIERS = {"bem": 1.25, "muito": 1.5, "super": 1.5, "extremamente": 2.0}
POLARITY = {
    "bom": 1.0, "delicioso": 1.5, "excelente": 2.0, "facil": 1.0, "macio": 1.0, "otimo": 1.7, "perfeito": 2.0, "rapido": 0.8,
    "saboroso": 1.5, "crocante": 0.8,
    "amargo": -1.0, "azedo": -1.0, "caro": -0.8, "demorado": -0.8, "dificil": -1.0, "lento": -0.8, "queimado": -1.5,
    "ruim": -1.5, "salgado": -0.8, "seco": -0.8,
}
ASPECTS = {
    "sabor": tuple("sabor gosto delicioso saboroso amargo azedo salgado".split()),
    "textura": tuple("textura macio crocante seco".split()),
    "tempo": tuple("tempo rapido lento demorado minuto hora".split()),
    "custo": tuple("custo preco barato caro".split()),
    "preparo": tuple("preparo facil dificil simples complexo".split()),
}

# Patterns of domain entities. Java and Python read them alike.
UNIT = r"(?:kg|g|mg|l|ml|x[ií]caras?|colheres?|unidades?|dentes?|pitadas?|latas?|pacotes?)"
NUMBER = r"(?:\d+\s*/\s*\d+|\d+(?:[.,]\d+)?)"
ENTITY_PATTERNS = {
    "DURATION": rf"\b{NUMBER}\s*(?:minutos?|horas?)\b",
    "TEMPERATURE": r"\b\d{2,3}\s*°?\s*[cC]\b",
    "QUANTITY": rf"\b{NUMBER}\b",
    "UNIT": rf"\b{UNIT}\b",
}

# Canonical labels.
DIFFICULTIES = {"facil": "fácil", "medio": "médio", "media": "médio", "dificil": "difícil"}
COSTS = {"custo baixo": "Custo baixo", "custo medio": "Custo médio", "custo alto": "Custo alto"}

# The steps of text preparation and its version.
PREPARATION_VERSION = "larder-preparation-2"
PREPARATION_STEPS = (
    "html_entities_decoded", "html_residual_removed", "urls_removed", "spaces_normalized", "casefolded", "accents_removed",
    "punctuation_and_symbols_removed", "word_tokenized", "pt_stopwords_removed_with_negation_preserved",
    "light_portuguese_stemming", "heuristic_portuguese_lemmatization",
)
LINGUISTIC_VERSION = "larder-rules-1"
