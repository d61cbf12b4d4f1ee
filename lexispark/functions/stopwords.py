"""Frequent function words of a few languages, in lower case."""

from __future__ import annotations

STOP_WORDS: dict[str, frozenset[str]] = {
    lang: frozenset(words.split())
    for lang, words in {
        "en": """a about above after again against all also am an and any are as at be because been before being below between both
            but by can could did do does doing down during each either else every few for from further had has have having he her
            here hers him his how i if in into is it its itself just least less many may me might mine more most much must my
            myself neither no nor not now of off often on once one only or other our ours out over own per quite rather same
            several she should since so some still such than that the their theirs them then there these they this those though
            through to too under until up upon us very was we were what when where whether which while who whom whose why will
            with within without would yet you your yours""",
        "de": """aber alle als also am an auch auf aus bei bin bis bist da damit dann das dass dein dem den der des dessen die dies
            diese dir doch dort du durch ein eine einem einen einer eines er es euer für hatte hier hinter ich ihr im in ist ja
            jede jeder kann kein können machen mein mit muss nach nicht noch nun nur ob oder ohne sehr sein seine sich sie sind so
            und uns unter vom von vor war warum was weil wenn wer wie wir wird zu zum zur zwischen über""",
        "fr": """au aux avec ce ces cette dans de des du elle elles en est et eux il ils je la le les leur lui ma mais me même mes moi
            mon ne nos notre nous on ou où par pas pour qu que qui sa se ses son sont sur ta te tes toi ton tu un une vos votre vous
            y à été être""",
        "es": """a al algo como con contra cual cuando de del desde donde durante e el ella ellas ellos en entre era es esa ese eso
            esta este esto está fue ha hasta hay la las le les lo los me mi muy más nada ni no nos nosotros o os otro para pero
            por porque que quien se ser si sin sobre son su sus sí también tan te tu tus un una uno y ya yo él""",
    }.items()
}


def stop_words(lang: str) -> frozenset[str]:
    """The language's words; of one that isn't known, none."""
    return STOP_WORDS.get(lang, frozenset())
