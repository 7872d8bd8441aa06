"""A small corpus: an act in force with a decree, two versions of the act to come, and three cases."""


def unit(no, title="", head="", paras=(), branch="", heading=False, effective="20200101", ref=""):
    para = lambda n, t, items=(): f"<항><항번호>{n}</항번호><항내용>{t}</항내용>{''.join(f'<호><호내용>{i}</호내용></호>' for i in items)}</항>"
    return (
        f"<조문단위><조문여부>{'전문' if heading else '조문'}</조문여부><조문번호>{no}</조문번호><조문가지번호>{branch}</조문가지번호><조문제목>{title}</조문제목>"
        f"<조문내용>{head}</조문내용><조문시행일자>{effective}</조문시행일자><조문참고자료>{ref}</조문참고자료>{''.join(para(*p) for p in paras)}</조문단위>"
    )


def act(units, clauses="", effective="20200101", law_id="001"):
    return f"<법령><기본정보><법령ID>{law_id}</법령ID><시행일자>{effective}</시행일자></기본정보><조문>{''.join(units)}</조문><부칙>{clauses}</부칙></법령>"


A5 = unit(5, "근로시간", paras=[("①", "1주 간의 근로시간은 40시간을 초과할 수 없다."), ("②", "당사자는 합의할 수 있다. &lt;개정 2021. 3. 5.&gt;"), ("③", "30명 미만은 8시간을 연장할 수 있다.")])
A6 = unit(6, "특례", paras=[("①", "다음 업종에는 제5조와 제7조를 적용하지 아니한다.", ["1. 육상운송", "2. 보건업"])])
A7 = unit(7, "휴일", head="제7조(휴일) 사용자는 휴일을 준다.")
A7_2 = unit(7, "대체휴일", paras=[("①", "제5조부터 제7조까지의 규정을 준용한다.")], branch="2")
NOW = act([unit(1, head="제1장 총칙", heading=True), unit(1, "목적", head="제1조(목적) 이 법은 근로를 정한다."), unit(2, head="제2장 시간", heading=True), A5, A6, A7, A7_2],
          "<부칙단위><부칙공포일자>20220101</부칙공포일자><부칙내용>제2조(유효기간) 제5조제3항의 개정규정은 2024년 12월 31일까지 효력을 가진다.</부칙내용></부칙단위>")
NEXT = act([unit(1, head="제1장 총칙", heading=True), unit(1, "목적", head="제1조(목적) 이 법은 근로를 정한다."), A5.replace("40시간", "36시간"), A6.replace("2. 보건업", "2. 보건업</호내용></호><호><호내용>3. 해운업"), A7, A7_2], effective="20270610")
LAST = act([unit(1, head="제1장 총칙", heading=True), unit(1, "목적", head="제1조(목적) 이 법은 근로를 정한다."), A5.replace("40시간", "36시간"), A7, A7_2, unit(9, "신설", head="제9조(신설) 새로운 조문이다.", effective="20280701")], effective="20280101")
DECREE = act([unit(3, "세부", paras=[("①", "법 제5조에 따른 시간과 법 제7조의2의 휴일을 정한다.")])], law_id="002")


def manifest():
    row = lambda name, mst, status, prom, eff: (name, "001", mst, status, prom, eff, "1", f"{name}/{mst}.xml", "")
    rows = [row("근로법", "m1", "현행", "20191201", "20200101"), row("근로법 시행령", "m4", "현행", "20191201", "20200101"), row("근로법", "m2", "시행예정", "20260601", "20270610"), row("근로법", "m3", "시행예정", "20260601", "20280101")]
    return list(zip(rows, [NOW, DECREE, NEXT, LAST], strict=True))


def case(no, refs, holding="판시한 바와 같다.", decided="20210304", body="주문 기각. 이유 살펴본다."):
    return f"<판례><사건번호>{no}</사건번호><사건명>임금</사건명><선고일자>{decided}</선고일자><참조조문>{refs}</참조조문><판시사항>[1] 근로시간의 범위에 관한 쟁점 하나</판시사항><판결요지>{holding}</판결요지><판례내용>{body}</판례내용></판례>"


CASES = [("a.xml", case("2020다1, 2020다2", "근로법 제5조, 제7조의2 / 민법 제3조")), ("b.xml", case("2021다3", "구 근로법(2019. 1. 1. 개정되기 전의 것) 제6조", "", "20230101")), ("c.xml", case("2020다1", "근로법 제1조"))]
