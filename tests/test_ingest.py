"""Reading small exports."""

from txnrules.sources import ingest as I


def amounts(d):
    return [round(r.amount, 2) for r in d.orderBy("date").collect()]


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_comma_and_quoted_thousands(spark, tmp_path):
    path = write(tmp_path, "us.csv", 'Date,Description,Amount\n01/01/2025,Groceries,123.45\n1/2/2025,Coffee SEATTLE WA,5.99\n01/03/2025,Rent,"1,234.56"\nbad,x,1\n01/04/2025,zero,0\n01/05/2025,,3\n')
    made = I.prepare(I.read_delimited(spark, path, 3), I.CARD, "card")
    assert amounts(I.good(made)) == [123.45, 5.99, 1234.56]
    assert [r.location for r in I.good(made).orderBy("date").collect()] == [None, "WA", None]
    assert sorted(r.reason for r in I.rejected(made).collect()) == ["bad date", "empty", "zero amount"]


def test_decimal_comma_and_semicolon(spark, tmp_path):
    path = write(tmp_path, "eu.csv", "Datum;Text;Betrag\n01-02-2025;A;-148,00\n02-02-2025;B;-8.000,00\n03-02-2025;C;9.132,36\n")
    shape = I.ColumnMap(date=0, description=1, amount=2, date_format="%d-%m-%Y", decimal=",")
    assert amounts(I.good(I.prepare(I.read_delimited(spark, path, 3, ";"), shape, "eu"))) == [-148.0, -8000.0, 9132.36]


def test_bank_lines_and_tabs(spark, tmp_path):
    path = write(tmp_path, "bank.txt", "opening\n\n01/01/2025  Groceries  -123.45  900.00\n01/02/2025  Coffee shop  -5.99  894.01\n01/03/2025  Rent  -1,234.56  10.00\n")
    assert amounts(I.good(I.prepare(I.read_pattern(spark, path, I.BANK_LINE), I.BANK, "bank"))) == [123.45, 5.99, 1234.56]
    path = write(tmp_path, "t.tsv", "Date\tDescription\tAmount\n01/01/2025\tA\t(5.00)\n01/02/2025 10:00\tB\t$6.50\n")
    assert amounts(I.good(I.prepare(I.read_delimited(spark, path, 3, "tab"), I.CARD, "t"))) == [-5.0, 6.5]


def test_sources_templates_and_missing_files(spark, tmp_path):
    path = write(tmp_path, "a.csv", "Date,Type,Merchant,Amount\n01/01/2025,Card,Shop,5\n")
    shape = I.ColumnMap(date=0, amount=3, captures={"type": 1, "merchant": 2}, template="{merchant} ({type})")
    rows = I.read_sources(spark, [(path, "one", shape), (str(tmp_path / "none.csv"), "two", shape), (path, "three", shape)]).orderBy("src_idx").collect()
    assert [(r.description, r.source, r.field["type"]) for r in rows] == [("Shop (Card)", "one", "Card"), ("Shop (Card)", "three", "Card")]


def test_supplemental_and_rule_tables(spark, tmp_path):
    path = write(tmp_path, "o.csv", "Item,Amount,Date\n Book ,20,01/05/2025\nToy,n/a,soon\n,,\n")
    got = I.read_supplemental(spark, path).orderBy("item").collect()
    assert [(r.item, r.amount, str(r.date), r.date_raw) for r in got] == [("Book", 20.0, "2025-01-05", "01/05/2025"), ("Toy", 0.0, "None", "soon")]
    path = write(tmp_path, "r.csv", "Pattern,Merchant,Category,Subcategory,Tags\n# comment\nCOSTCO,Costco,Food,Grocery,Bulk| weekly\n,none,,,\nSTARBUCKS,Starbucks,Food,Coffee,\n")
    assert [(r.merchant, r.tags) for r in I.read_rule_table(spark, path).orderBy("ord").collect()] == [("Costco", ["bulk", "weekly"]), ("Starbucks", [])]
