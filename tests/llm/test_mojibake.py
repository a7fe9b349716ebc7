import random

import pytest

from lodegraph.llm import mojibake as M

GERMAN = "Für die Tabelle fehlt ein Primärschlüssel und die Verknüpfung über die Spalte ist ungültig größtenteils außerhalb geprüft".split()
RUSSIAN = "Отчёт построен по данным последнего сканирования доля неразрешённых вызовов снизилась таблице первичного ключа".split()
KOREAN = "계층 구조가 순환하면 경로를 표시하지 않는다 미해결 호출 비율이 줄었다 분석 대상을 찾지 못했으므로".split()


def corpus(seed=1, n=400):
    rnd = random.Random(seed)
    rows, bad = [], set()
    swaps = [("cp1252+", "utf_8"), ("mac_roman", "cp1252+"), ("cp1251+", "utf_8"), ("latin_1", "utf_8")]
    for i in range(n):
        ws = [rnd.choice(rnd.choice([GERMAN, RUSSIAN, KOREAN])) for _ in range(20)]
        if i % 20 == 0:
            page, true = swaps[(i // 20) % len(swaps)]
            ws = [rnd.choice(GERMAN) for _ in range(20)]
            k = rnd.randrange(15)
            data = " ".join(ws[k : k + 5]).encode(true.rstrip("+"))
            ws[k : k + 5] = [M._decode(data, page)]
            if data.isascii():
                continue
            bad.add(i)
        rows.append((i, " ".join(ws), f"s{i % 3}"))
    return rows, bad


def test_finds_and_restores(spark):
    rows, bad = corpus()
    rows += [(1000, None, "s1"), (1001, "", None), (1002, "plain", None), (1003, "ge�ndert", None), (1004, "✅ 25 °C — “ok” 👩‍💻 ½ × ±3", "s1")]
    df = spark.createDataFrame(rows * 2, "doc_id long, text string, source string")
    got = [r.doc_id for r in M.found(df, "doc_id", "text", "source").collect()]
    assert len(got) == len(set(got))
    assert set(got) >= {1003} and not set(got) & {1000, 1001, 1002, 1004}
    hit = set(got) - {1003}
    assert len(hit & bad) >= 0.9 * len(bad) and len(hit - bad) <= 1
    assert M.found(df.where("false"), "doc_id", "text", "source").collect() == []


@pytest.mark.parametrize("page,true", [("cp1252+", "utf_8"), ("cp1251+", "koi8_r"), ("cp949", "utf_8"), ("cp1252+", "cp932"), ("cp437", "utf_8")])
def test_readings_hold_the_original(page, true):
    word = {"koi8_r": "таблице", "cp932": "ファイル"}.get(true, "계층" if page == "cp949" else "größtenteils")
    seen = M._decode(word.encode(true), page)
    if seen is None:
        pytest.skip("lossy")
    options = dict(M.readings(seen))
    ciphers = [c for c, t in options.items() if t == word]
    assert ciphers and M.apply_cipher(seen, ciphers[0]) == word


GREEK = "το αρχείο περιέχει τη δομή των πινάκων και τις σχέσεις μεταξύ τους κάθε γραμμή είναι μία εγγραφή του συστήματος όταν λείπει το κλειδί η αναφορά δεν βρίσκεται πρέπει να ελεγχθεί πριν από την επόμενη εκτέλεση".split()
HEBREW = "הקובץ מכיל את מבנה הטבלאות ואת הקשרים ביניהן כל שורה היא רשומה של המערכת כאשר חסר מפתח ההפניה אינה נמצאת ויש לבדוק אותה לפני ההרצה הבאה של התהליך בשרת הראשי".split()
THAI = "ไฟล์นี้ มีโครงสร้าง ของตาราง และความสัมพันธ์ ระหว่างกัน ทุกบรรทัด เป็นระเบียน ของระบบ เมื่อไม่มี กุญแจ จะไม่พบ การอ้างอิง ต้องตรวจสอบ ก่อนการทำงาน ครั้งถัดไป บนเครื่อง แม่ข่าย หลัก".split()
RUSSIAN_MORE = RUSSIAN + "файл содержит структуру таблиц и связи между ними каждая строка это запись системы когда ключа нет ссылка не найдена её нужно проверить перед следующим запуском на главном сервере".split()


def invented(rnd):
    """A page that no book has: the letters of the Russian alphabet on bytes in random order, read as cp1252."""
    letters = sorted({c for w in RUSSIAN_MORE for c in w})
    seen = rnd.sample([c for c in map(chr, range(0xC0, 0x100)) if c.isalpha()], len(letters))
    return dict(zip(letters, seen))


@pytest.mark.parametrize("kind", ["greek", "hebrew", "thai", "invented"])
def test_learns_pages_outside_the_book(spark, kind):
    rnd = random.Random(5)
    clean = {"greek": GREEK, "hebrew": HEBREW, "thai": THAI, "invented": RUSSIAN_MORE}[kind]
    page = {"greek": "cp1253", "hebrew": "cp1255", "thai": "cp874"}.get(kind)
    swap = invented(rnd) if kind == "invented" else {c: M._decode(c.encode(page), "cp1252+") for w in clean for c in w}
    rows, bad, truth = [], set(), {}
    for i in range(600):
        ws = [rnd.choice(clean) for _ in range(25)]
        if i % 6 == 0 and i % 40 == 0:
            truth[i] = " ".join(ws)
            ws = ["".join(swap[c] for c in w) for w in ws]
            bad.add(i)
        elif i % 3 == 0:
            ws = [rnd.choice(GERMAN) for _ in range(25)]
        rows.append((i, " ".join(ws), "odd" if i % 40 == 0 else f"s{i % 5}"))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    learned = M.learn(df, "text", "source", 8)
    got = {r.doc_id: r.repaired for r in M.repair(df, "doc_id", "text", "source", learned).where("n_restored > 0").collect()}
    assert len(set(got) & bad) >= 0.9 * len(bad) and len(set(got) - bad) <= 1
    right = sum(a == b for i in bad & set(got) for a, b in zip(got[i].split(), truth[i].split()))
    assert right >= 0.8 * 25 * len(bad)
