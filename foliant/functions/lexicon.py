"""Fixed values of query analysis: legal terms, variants, connectors. All are defaults of parameters."""

# Spelling variant -> canonical term.
VARIANTS = {
    "提前釋放": "假釋", "提前释放": "假釋", "有條件釋放": "假釋", "保释": "假釋", "保釋": "假釋",
    "量刑明顯過重": "量刑過重", "量刑明显过重": "量刑過重", "刑罰過重": "量刑過重", "刑罚过重": "量刑過重",
    "判刑過重": "量刑過重", "判刑过重": "量刑過重", "暫緩執行": "緩刑", "暂缓执行": "緩刑", "假釋申請": "假釋",
    "合約不能履行": "合同不能履行", "合同之不能履行": "合同不能履行", "不能履行合同": "合同不能履行",
    "損失賠償": "損害賠償", "賠償損失": "損害賠償", "损害赔偿": "損害賠償", "诽谤": "誹謗",
    "名誉损害": "名譽受損", "名譽損害": "名譽受損", "上诉": "上訴", "終審上訴": "上訴", "假释": "假釋",
}

# Concept -> expansions.
EXPANSIONS = {
    "假釋": ("提前釋放", "有條件釋放", "liberdade condicional", "刑法典第56條"),
    "量刑過重": ("刑罰過重", "判刑過重", "erro ostensivo na apreciação da prova", "改判"),
    "緩刑": ("緩期執行", "暫緩執行"),
    "上訴": ("提起上訴", "recurso", "recorrer"),
    "損害賠償": ("民事賠償", "responsabilidade civil", "indemnização", "dano moral"),
    "合同不能履行": ("履行不能", "債務不履行", "incumprimento contratual"),
    "誹謗": ("名譽", "侮辱", "difamação"),
    "假釋撤銷": ("revogação da liberdade condicional", "撤銷假釋"),
}

# Terms the tokenizer emits by themselves when a Han run holds them.
HINTS = ("假釋", "緩刑", "量刑", "上訴", "損害賠償", "合同不能履行", "誹謗", "詐騙", "違令", "刑法典")

# Concepts, facts and connectors of query classification.
CONCEPTS = (
    "假釋", "假释", "量刑", "誹謗", "诽谤", "緩刑", "缓刑", "詐騙", "诈骗", "侵權", "侵权", "損害賠償", "损害赔偿",
    "上訴", "上诉", "撤銷", "撤销", "再審", "再审", "抗告",
)
FACTS = (
    "被告", "原告", "告訴人", "告诉人", "證據", "证据", "證人", "证人", "供述", "契約", "合同", "損失", "损失", "傷害", "伤害",
    "事實", "事实",
)
CONNECTORS = ("與", "和", "及", "並", "且", "同時", "以及", "、", ",", "，", ";", "；")
ISSUE_CONNECTORS = (" e ", " ou ", " bem como ", "以及", "及", "與", "和", ";", "；")
NOISE = ("help", "pls", "請問", "幫我", "看看", "?", "？？")

# Portuguese legal words that mark a Portuguese query.
PT_WORDS = (
    "acórdão", "acordao", "tribunal", "processo", "decisão", "decisao", "recurso", "arguido", "autor", "réu", "reu", "juiz",
    "liberdade condicional", "erro ostensivo", "legis artis", "matéria cível", "materia civel", "responsabilidade civil",
    "dano moral", "habeas corpus", "suspensão da execução da pena", "suspensao da execucao da pena", "pena suspensa",
    "difamação", "difamacao", "indemnização", "indemnizacao",
)

# Terms of issue decomposition -> canonical term, and fact terms.
ISSUE_CONCEPTS = {
    "假釋": "假釋", "假释": "假釋", "量刑過重": "量刑過重", "量刑过重": "量刑過重", "誹謗": "誹謗", "诽谤": "誹謗", "緩刑": "緩刑",
    "缓刑": "緩刑", "詐騙": "詐騙", "诈骗": "詐騙", "加重詐騙": "加重詐騙", "加重诈骗": "加重詐騙", "損害賠償": "損害賠償",
    "损害赔偿": "損害賠償", "過失": "過失", "故意": "故意", "自首": "自首",
}
ISSUE_STEPS = {
    "上訴": "上訴", "上诉": "上訴", "撤銷": "撤銷", "撤销": "撤銷", "駁回": "駁回", "驳回": "駁回", "改判": "改判", "抗告": "抗告",
    "再審": "再審", "再审": "再審",
}
ISSUE_FACTS = ("被告", "原告", "告訴人", "證據", "證人", "供述", "契約", "合同", "侵占", "侵權", "賠償", "損失", "傷害")

# Hints that a Portuguese query names a case.
PT_CASE_HINTS = ("processo n", "processo nº", "recurso", "matéria cível", "materia civel")

# Simplified sign or word -> traditional form.
TRADITIONAL = {
    "这": "這", "为": "為", "与": "與", "争": "爭", "议": "議", "点": "點", "审": "審", "查": "查", "确认": "確認", "维": "維", "处": "處",
    "罚": "罰", "诉": "訴", "讼": "訟", "条": "條", "体": "體", "后": "後", "发": "發", "门": "門", "国": "國", "应": "應", "执": "執",
    "认": "認", "实": "實",
}
