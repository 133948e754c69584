from foliant.llm.leakage import SLOTS, leaks

PT = (
    "Em 13/08/2004, a concessionária hipotecou duas vezes o jazigo com selo de chumbo, após a terceira inspecção, no valor de MOP 73.180,19. "
    "Em 6 de Julho de 2017, a herdeira perdeu durante o tufão a embarcação de pesca restaurada à mão, mediante recibo rasurado, no valor de 67.889,34 patacas. "
    "O tutor penhorou o piano de cauda avaliado por defeito na véspera do casamento, o que custou 84.592,79 patacas a Rui Vasqueda."
)
ZH = "受寄人祝澄翊兩度抵押價值澳門元87,124.90元的被鹽分侵蝕的鹽倉，事前沒有聽取監事會意見。保險公司闕沅霏在拍賣中買下價值12262.24元的附有鉛封的一批茶葉，其後已作第三次檢查。保證人狄楷楷在風災中遺失價值43萬871元的蓋上帆布的家傳首飾。"
PROSE = "O recorrente alega que o imóvel nunca esteve arrendado a terceiros e que a perícia não abrangeu o segundo lote. "


def run(spark, docs, items=((1, PT), (2, ZH))):
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id bigint, text string, item_id int")
    e = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id bigint, text string, doc_id int")
    return {(r.doc_id, r.item_id): r for r in leaks(d, e).collect()}


def test_disguises_are_found_and_decoys_are_not(spark):
    cut = PT[100:420]
    docs = [
        (1, PROSE + PT + PROSE), (2, PROSE + cut.upper() + PROSE), (3, PROSE + cut.replace("ã", "a").replace("é", "e") + PROSE),
        (4, "<p>" + cut.replace(" ", "\n") + "</p>"), (5, cut.replace("tufão", "temporal").replace("mediante", "com")), (6, ZH.replace("，", ",")),
        (7, PROSE * 20), (8, PT[:90] + PROSE), (9, None), (10, ""), (11, " "), (12, PROSE + PT + ZH), (12, PROSE + PT + ZH),
        (13, PT.translate(str.maketrans("0123456789", "9876543210"))), (14, "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in cut)),
    ]
    got = run(spark, docs)
    found = {k for k, r in got.items() if r.slots_equal >= SLOTS}
    assert found == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (6, 2), (12, 1), (12, 2), (14, 1)}
    assert got[13, 1].slots_equal < SLOTS  # other figures in the same template


def test_empty_sides_and_short_items(spark):
    assert run(spark, [], ((1, PT),)) == {}
    assert run(spark, [(1, PT)], ()) == {}
    assert run(spark, [(1, PT)], ((1, "curto"), (2, None), (3, ""))) == {}


def test_a_join_by_shuffle_gives_the_same(spark, monkeypatch):
    from foliant.llm import leakage

    docs = [(1, PT), (2, PROSE + ZH), (3, PT[100:420].upper())]
    a = run(spark, docs)
    monkeypatch.setattr(leakage, "POSTINGS", 0)
    assert run(spark, docs) == a and set(a) == {(1, 1), (2, 2), (3, 1)}


def test_short_han_items_and_long_markup(spark):
    short = "保證人擅自更換漆成綠色的三角鋼琴"  # 16 signs
    far = PT.replace("herdeira perdeu", f'<a href="https://exemplo.test/{"x" * 900}">herdeira</a> perdeu')
    got = run(spark, [(1, "其後沒有再作補充。" + short + "。聽證繼續。"), (2, far), (3, "聽證繼續。")], ((1, PT), (3, short)))
    assert set(got) == {(1, 3), (2, 1)} and got[2, 1].share > 0.95


def test_placeholders_are_typed():
    from foliant.llm.leakage import typed_signs

    same = lambda a, b: typed_signs(a) == typed_signs(b)
    assert same("pagou MOP 4.830,16 a Lídia Gradelha", "pagou 75 patacas a Rui Vasqueda")
    assert same("em 6 de Julho de 2017, foi", "em 1 de Março de 2001, foi") and same("收取澳門元91,889.68元", "收取48萬182元")
    assert same("on 8 September 2023 the", "on 21 May 2020 the") and same("durante 12 anos e", "durante 3 meses e")
    assert not same("durante 12 anos", "durante 12 patacas") and not same("a 5 km de", "a 5 de")


def test_names_tell_copies_without_figures(spark):
    plain = "A escritura foi lavrada na presença de {0}, que recusou entregar as jóias a {1}, e o tutor, ouvido {2}, devolveu com defeito o piano de cauda antes da moratória."
    item = plain.format("Odete Lamegal", "Gaspar Gradelha", "Lídia Troncável")
    got = run(spark, [(1, PROSE + item), (2, PROSE + plain.format("Rui Vasqueda", "Célia Varomil", "Abílio Bragonde"))], ((1, item),))
    assert got[1, 1].slots_equal == 1.0 and got[2, 1].slots_equal < SLOTS


def test_a_true_stretch_beside_a_longer_refilled_copy(spark):
    refilled = PT.translate(str.maketrans("0123456789", "9876543210"))
    got = run(spark, [(1, refilled + PROSE * 5 + PT[100:330]), (2, refilled + PROSE * 5)])
    assert got[1, 1].slots_equal >= SLOTS and got[1, 1].share < 0.7
    assert got[2, 1].slots_equal < SLOTS and got[2, 1].share > 0.9


def test_repeats_of_a_clause_do_not_hide_the_stretch(spark):
    clause, filler = PT[:90], "Outra matéria sem relação alguma ocupa o resto deste parágrafo, palavra por palavra. " * 3
    # one letter in twenty-five changed: few windows are left
    reworded = "".join("x" if i % 25 == 0 and c.isalpha() else c for i, c in enumerate(PT[140:]))
    got = run(spark, [(1, (clause + filler) * 12 + reworded), (2, (clause + filler) * 12)])
    assert set(got) == {(1, 1)} and got[1, 1].slots_equal >= SLOTS


def test_figures_are_read_where_the_stretch_is(spark):
    menu = "".join(f"[Secção de processos cíveis número {i}](https://exemplo.test/{i}) " for i in range(20))
    foreign = PROSE + "Ficaram pagas as custas de 55.555,11 e de 44.444,22 patacas. " * 9
    spelled = "Oﬃcio… " * 40
    labelled = PT.replace("73.180,19", "[73.180,19](https://exemplo.test/a)").replace("67.889,34", "[67.889,34](https://exemplo.test/b)")
    got = run(spark, [(1, menu + PT + foreign), (2, spelled + PT + foreign), (3, labelled + foreign), (4, menu + PT.translate(str.maketrans("0123456789", "9876543210")) + PT[240:300])])
    assert {k for k, r in got.items() if r.slots_equal >= SLOTS} == {(1, 1), (2, 1), (3, 1)}
    assert got[1, 1].slots_equal == got[2, 1].slots_equal == got[3, 1].slots_equal == 1.0
