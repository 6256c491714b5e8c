from datetime import date

from vitrine.plans.pipeline import run

COLUMNS = (
    "url string, site string, titulo string, bairro string, cidade string, preco double, quartos int, area_m2 double, primeiro_visto date, ultimo_visto date, logradouro string, numero string, cep string, condominio_nome string, latitude double, longitude double, "
    "banheiros int, suites int, vagas int, andar int, aluguel double, condominio double, iptu double, custo_mensal_total double, custo_completo boolean, descricao string, fotos array<string>, imobiliaria string, telefone string, status string"
)


def listing(url, site, preco=2000.0, area=72.0, status="ATIVO"):
    d = date(2026, 1, 1)
    return (url, site, "t", "Centro", "Recife", preco, 3, area, d, d, "Rua A", "10", None, None, None, None, 2, 1, 1, None, preco, None, None, preco, True, "x" * 70, None, None, None, status)


def test_run(spark):
    batch = spark.createDataFrame([listing("u1", "A"), listing("u2", "B", 1980.0), listing("u3", "C", 5000.0, 200.0)], COLUMNS)
    stored = spark.createDataFrame([listing("u1", "A", 2100.0, status="SUSPEITO"), listing("u9", "Z")], COLUMNS)
    out = run(stored, batch)
    assert {r["url"]: r["is_new"] for r in out.listings.collect()} == {"u1": False, "u2": True, "u3": True, "u9": False}
    assert sorted((r["url"], r["kind"], r["delta"]) for r in out.events.collect() if r["kind"] != "CRIADO") == [("u1", "PRECO_ALTERADO", -100.0), ("u1", "REAPARECEU", None)]
    kinds = {r["url"]: r["classificacao"] for r in out.links.collect()}
    assert kinds == {"u1": "MESMO_IMOVEL", "u2": "MESMO_IMOVEL", "u3": "UNICO"}
    both = [r for r in out.entities.collect() if r["qtd_fontes"] == 2]
    assert len(both) == 1 and both[0]["sites"] == ["A", "B"] and both[0]["economia"] == 20.0 and both[0]["preco"] == 1990.0
    assert [(r["campo"], r["criterio"]) for r in out.conflicts.collect() if r["campo"] == "preco"] == [("preco", "mediana")]
    again = run(batch.select("*"), batch)
    assert again.events.count() == 0
