"""Column lists and schemas of the tables the jobs exchange."""

from __future__ import annotations

# Columns of a correction file, in file order.
FEEDBACK_COLUMNS = (
    "aonde gastou", "natureza do gasto", "valor total", "parcelas", "no da parcela", "valor unitário", "tipo",
    "comp", "data", "cartao", "transactionId", "modelVersion", "createdAt", "flux",
)
# Columns of the training base, in file order.
BASE_COLUMNS = (
    "aonde gastou", "natureza do gasto", "valor total", "parcelas", "no da parcela", "valor unitário", "tipo",
    "comp", "cartao", "origem",
)
ESSENTIAL_COLUMNS = BASE_COLUMNS[:-1]


def all_strings(columns) -> str:
    return ", ".join(f"`{c}` string" for c in columns)


# Field names of the JSON bodies and files that are exchanged.
FEEDBACK_ITEM = (
    "transactionId string, description string, amount double, date string, source string, card string, "
    "modelVersion string, createdAt string, category string, flux string, comp string, parcelas int, numero_parcela int"
)
TRANSACTION = (
    "id string, description string, amount double, date string, card_number string, card_holder string, "
    "origin string, installments int, installment_number int, metadata map<string,string>"
)
SETTINGS = (
    "similarity_threshold double, model_threshold double, enable_deterministic_rules boolean, "
    "enable_tfidf_similarity boolean, enable_fallback_ai boolean, use_pipeline_model boolean"
)
REQUEST = f"transactions array<struct<{TRANSACTION.replace(' string', ':string').replace(' double', ':double').replace(' int', ':int').replace(' map', ':map')}>>, config struct<{SETTINGS.replace(' double', ':double').replace(' boolean', ':boolean')}>"
STATEMENT_ITEM = (
    "date:string,description:string,amount:string,last4:string,flux:string,source:string,parcelas:int,numero_parcela:int"
)
GOLDEN = (
    f"items array<struct<{STATEMENT_ITEM}>>, "
    "stats struct<total_lines:int,matched:int,rejected:int,sum_abs_values:string,sum_saida:string,sum_entrada:string,"
    "by_card:map<string,struct<control_total:string,calculated_total:string,delta:string>>>, "
    "rejects array<struct<line:string,reason:string>>"
)
