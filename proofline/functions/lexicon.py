"""Fixed values of the phrase detector: weighted phrases, structural patterns and constants."""

# --- fixed values ------------------------------------------------------------------------------------------
LEXICON = {
    "delve": 3.0, "delves": 3.0, "delving": 3.0, "tapestry": 3.0, "underscore": 2.0, "underscores": 2.5,
    "underscoring": 2.5, "testament to": 2.5, "multifaceted": 2.0, "intricate": 1.5, "intricacies": 2.0,
    "pivotal": 1.5, "meticulous": 1.5, "meticulously": 2.0, "seamless": 1.5, "seamlessly": 2.0, "leverage": 1.0,
    "leveraging": 1.5, "foster": 1.0, "fostering": 1.5, "garner": 1.5, "garnered": 1.5, "boast": 1.5, "boasts": 2.0,
    "boasting": 1.5, "vibrant": 1.5, "bustling": 2.0, "realm": 1.5, "realms": 1.5, "landscape": 1.0,
    "landscapes": 1.0, "beacon": 2.0, "crucible": 2.0, "paradigm": 1.5, "holistic": 1.5, "robust": 1.0,
    "showcase": 1.5, "showcasing": 2.0, "showcases": 1.5, "elevate": 1.5, "elevates": 1.5, "embark": 2.0,
    "embarking": 2.0, "unleash": 2.0, "unlock": 1.0, "unlocking": 1.5, "invaluable": 1.5, "commendable": 2.0,
    "noteworthy": 1.5, "unwavering": 2.0, "ever-evolving": 2.5, "ever-changing": 2.0, "game-changer": 2.0,
    "game changer": 2.0, "transformative": 1.5, "revolutionize": 2.0, "revolutionizing": 2.0, "synergy": 1.5,
    "empower": 1.5, "empowering": 1.5, "empowers": 1.5, "resonate": 1.5, "resonates": 1.5, "captivating": 1.5,
    "enduring": 1.0, "profound": 1.0, "myriad": 1.5, "plethora": 2.0, "nuanced": 1.5, "nuances": 1.5,
    "it's important to note": 3.0, "it is important to note": 3.0, "it's worth noting": 3.0,
    "it is worth noting": 3.0, "it should be noted": 2.5, "in today's fast-paced world": 3.0,
    "in today's digital age": 3.0, "in the ever-evolving": 3.0, "in the realm of": 2.5, "at the heart of": 1.5,
    "when it comes to": 1.0, "plays a crucial role": 3.0, "plays a vital role": 3.0, "plays a pivotal role": 3.0,
    "play a crucial role": 3.0, "a wide range of": 1.5, "a wide array of": 2.0, "a rich tapestry": 3.0,
    "serves as a": 1.5, "stands as a": 2.0, "look no further": 2.5, "in conclusion": 2.0, "in summary": 1.5,
    "furthermore": 1.5, "moreover": 1.5, "additionally": 1.0, "overall": 0.5, "ultimately": 1.0,
    "navigating the": 2.0, "the world of": 1.0, "dive into": 1.5, "dive deeper": 2.0, "deep dive": 1.5,
    "shed light on": 2.0, "sheds light on": 2.0, "paving the way": 2.5, "pushing the boundaries": 2.5,
    "a double-edged sword": 2.5, "cannot be overstated": 3.0, "continues to evolve": 2.5, "remains to be seen": 2.0,
    "as we navigate": 2.5, "treasure trove": 2.5, "whether you're a": 2.5, "whether you are a": 2.5,
    "here are some": 1.0, "let's explore": 2.0, "let's dive": 2.0, "key takeaways": 2.0, "actionable insights": 2.5,
    "best practices": 1.0, "harness the power": 3.0, "harnessing the power": 3.0,
}
# a word character is a letter, a number or an underscore; marks and joiners are none
_W = r"[\p{L}\p{N}_]"
_IN = r"[\p{L}\p{N}_'’-]"
# name, pattern in Java's dialect, weight
STRUCTURAL = (
    ("not_only_but_also", rf"(?Uis)(?<!{_W})not only(?!{_W}).{{1,120}}?(?<!{_W})but also(?!{_W})", 2.0),
    ("from_x_to_y_frame", rf"(?Ui)(?<!{_W})from {_W}+(?: {_W}+)? to {_W}+(?: {_W}+)?, ", 1.0),
    ("bullet_with_bold_lead", r"(?Umd)^\s*[-*•]\s*\*\*[^*]+\*\*[:,]", 1.5),
    ("numbered_bold_lead", r"(?Umd)^\s*\d+\.\s*\*\*[^*]+\*\*[:,]", 1.5),
    ("colon_triad_header", r"(?Umd)^#{1,4}\s", 0.5),
)
TRIAD = rf"(?Ui)(?<!{_W}){_W}{_IN}*, {_W}{_IN}*(?: {_W}{_IN}*)?, and {_W}{_IN}*"
TRIADS_PER_SENTENCE, RATE_SCALE, SCORE_FLOOR = 0.25, 18.0, 0.30
# -------------------------------------------------------------------------------------------------------------
