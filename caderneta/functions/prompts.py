"""Prompt text for an external classifier and parsing of its reply. No call is made here."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from caderneta.functions.text import establishment_name, strip

# The category domain.
CATEGORIES = (
    "Conta de luz",
    "Conta de gás",
    "Internet & TV a cabo",
    "Moradia (Financiamento/ Aluguel/ Condominio)",
    "Gastos com mensalidades (Gympass, Spotfy, Unicef e Rappi)",
    "Planos de celular",
    "Gastos com Diarista",
    "Gastos com Educação (Inglês, MBA, Pós)",
    "Farmácia",
    "Supermercado",
    "Casamento",
    "Restaurantes/ Bares/ Lanchonetes",
    "Viagens / Férias",
    "Carro (Manutenção/ IPVA/ Seguro)",
    "Combustível/ Passagens/ Uber / Sem Parar",
    "Cuidados Pessoais (Nutricionista / Medico / Suplemento)",
    "Gastos com casa (outros)",
    "Gastos com presentes",
    "Gastos pessoais",
    "Gastos com Cachorro",
    "Futevolei",
    "Financiamento/Condominio",
    "Obra casa",
    "Inteligência Artificial",
    "Investimento",
    "Salário",
    "Transferencia Interna",
)
# The prompt offers every category but internal transfers.
PROMPT_CATEGORIES = CATEGORIES[:-1]
UNSURE_CATEGORY = "Gastos pessoais"
MIN_REPLY_CONFIDENCE = 0.5

# The prompt wording, so that replies keep their format.
PROMPT_HEAD = """Você é um assistente financeiro inteligente com acesso a ferramentas de busca como o SerpAPI.
Sua tarefa é analisar uma transação da fatura de cartão de crédito e classificá-la corretamente com base nas informações obtidas online.

### Transação:"""
PLACE_HEAD = "### Estabelecimento identificado:"
CONTEXT_HEAD = "### Resultado da pesquisa na internet:"
PROMPT_TAIL = (
    "\n### Categorias disponíveis:\n"
    + ", ".join(PROMPT_CATEGORIES)
    + """

Com base nas informações acima, siga os passos:
1. Determine o setor de atividade ou tipo de serviço prestado pelo estabelecimento.
2. Escolha uma única categoria da lista que melhor representa o tipo de gasto.

Responda APENAS com o formato:
CATEGORIA: [nome da categoria]
CONFIANÇA: [0.0-1.0]

Exemplo:
CATEGORIA: Supermercado
CONFIANÇA: 0.85"""
)


def sql_literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), c, F.lit('"'))


def classification_prompt(description: Column, context: Column | None = None) -> Column:
    """One prompt per description; ``context`` holds search snippets where there are any."""
    found = F.lit(None).cast("string") if context is None else F.nullif(strip(context), F.lit(""))
    middle = F.coalesce(F.concat(F.lit(f"\n{CONTEXT_HEAD}\n"), _quoted(found)), F.lit(""))
    return F.concat_ws(
        "\n",
        F.lit(PROMPT_HEAD),
        _quoted(description),
        F.lit(""),
        F.lit(PLACE_HEAD),
        _quoted(establishment_name(description, for_prompt=True)),
        middle,
        F.lit(PROMPT_TAIL),
    )


def parse_reply(reply: Column) -> Column:
    """struct(category, confidence) of a ``CATEGORIA:`` / ``CONFIANÇA:`` reply; an unreadable number counts 0.5.

    When a line is repeated the last one counts.
    """
    last = r"(?s)^.*(?:^|\n)\s*{}:([^\n]*)"
    category = F.regexp_extract(reply, last.format("CATEGORIA"), 1)
    number = F.regexp_extract(reply, last.format("CONFIANÇA"), 1)
    has_category = F.rlike(reply, F.lit(r"(?m)^\s*CATEGORIA:"))
    has_number = F.rlike(reply, F.lit(r"(?m)^\s*CONFIANÇA:"))
    return F.struct(
        F.when(has_category, strip(category)).alias("category"),
        F.when(has_number, F.coalesce(strip(number).try_cast("double"), F.lit(0.5))).otherwise(0.0).alias("confidence"),
    )


def accepted_reply(reply: Column, minimum: float = MIN_REPLY_CONFIDENCE) -> Column:
    """The parsed reply when it names a category and is more than ``minimum`` sure, else null."""
    parsed = parse_reply(reply)
    usable = F.coalesce(parsed["category"] != "", F.lit(False)) & (parsed["confidence"] > minimum)
    return F.when(usable, parsed)


def parse_bar_reply(reply: Column, categories: Sequence[str] = CATEGORIES) -> Column:
    """struct(category, confidence) of a ``CATEGORY|0.8`` reply; unknown categories become the default one."""
    category = strip(F.split_part(reply, F.lit("|"), F.lit(1)))
    number = strip(F.regexp_extract(reply, r"(?s)^[^|]*\|(.*)$", 1)).try_cast("double")
    known = F.when(category.isin(*categories), category).otherwise(F.lit(UNSURE_CATEGORY))
    readable = F.contains(reply, F.lit("|")) & number.isNotNull()
    return F.struct(
        F.when(readable, known).otherwise("").alias("category"),
        F.when(readable, F.least(F.greatest(number, F.lit(0.0)), F.lit(1.0))).otherwise(0.0).alias("confidence"),
    )
