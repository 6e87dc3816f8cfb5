"""Example messages (text, class) used to phrase the derived messages view: fixed values, and messages composed
from the word lists so that every list is met."""

from ..functions import vocabulary as V

SUBJECTS = ("the report", "my bicycle", "a library book", "the garden door", "our train")


def composed(rows: int = 13) -> list[tuple[str, str]]:
    """Messages put together from the word lists, each list at its own pace: two of three offer something, the
    third is plain talk."""
    slang = sorted(V.SLANG)
    turn = lambda words, i, step: words[i * step % len(words)]
    out = []
    for i in range(rows):
        if i % 3 == 2:
            out.append((f"{turn(V.GREETING, i, 1)}, {turn(SUBJECTS, i, 2)} is {turn(V.TIME, i, 5)} at number {i}", "low"))
        else:
            amount = f", {i + 2}{turn(('g', 'oz', ' tab'), i, 1)} ${15 * i + 20}" if i % 2 else ""
            out.append((f"{turn(slang, i, 11)} {turn(V.QUALITY, i, 3)}{amount}: {turn(V.TRANSACTION, i, 2)}, "
                        f"{turn(V.LOCATION, i, 3)}, {turn(V.PAYMENT, i, 2)} {turn(V.DISCRETION, i, 1)} {turn(V.URGENCY, i, 4)}", "high"))
    return out


PHRASES: tuple[tuple[str, str], ...] = (
    ("Hello, how are you today?", "low"),
    ("got that good work 💊, $30 per half, dm", "high"),
    ("Let's meet for coffee tomorrow", "low"),
    ("fresh batch just landed, limited time only 🔥", "high"),
    ("What's the weather like?", "low"),
    ("need that 🔌 asap, got cash", "high"),
    ("How was your weekend?", "low"),
    ("quality stuff available, dm for menu", "high"),
    ("Can you help me with homework?", "low"),
    ("🔥 pure grade, $100 per g, meet at usual spot", "high"),
    ("Good morning! How are you?", "low"),
    ("$50 per gram, meet at the usual place", "high"),
    ("Have a great day!", "low"),
    ("need 🔌 asap, got the cash ready", "high"),
    ("meet me at the usual spot to discuss business", "high"),
    ("got some good stuff to share with you", "high"),
    ("bringing the package tonight", "high"),
    ("watching the game 🏈 and got some 🔥 too", "low"),
    ("party supplies ready 🎉 plus some extra goodies 💊", "high"),
    ("just picked up my prescription from the pharmacy", "low"),
    ("bringing snacks and drinks to the party", "low"),
    ("prices updated, check dm for menu", "high"),
    ("new batch just landed, limited time only", "high"),
    ("🔌 💊 💵", "high"),
    ("🎯 🎪 🎭", "low"),
    *composed(),
    ("yo got fire 💊 dm me $30 cash only asap", "high"),
    ("grow a 🪴 and 5 ounce", "high"),
    ("mary jane, weed weed candy", "high"),
    ("5 guys know this stop", "low"),
    ("price list\nline 5", "low"),
    ("", "low"),
    ("   \t ", "low"),
    ("private  spot, no questions 🤑💉 price negotiable, exactly 3 g, urgent 10pm tonight", "high"),
    ("low   key corner usual 22:30 later ❄️ 😮💨 ⚡ ₹ 500 real deal", "high"),
    ("pay with CRYPTO or gpay, blues and dragon and crystal meth in stock #1 @you 100%", "high"),
    ("broken� text�  here  ok", "low"),
    ("<script>alert(1)</script> hi", "low"),
    ("click onload = now", "low"),
    ("ÉCOLE déjà vu café", "low"),
    ("dragon dragon o clock, the last few remaining bulk sample only", "high"),
)
