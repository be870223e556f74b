"""The English phrases that mark a text as worth remembering or as withdrawn, by their last words' length."""

#: Each line: a common head before the slash and its endings, separated by commas; an ending '.' is none.
_AFFIRM = """
i/ tested, agree, checked, promise, verified, validated, understand, looked it up, reproduced it, won't forget
i'll/ fix it, follow up, handle it, make sure, look into it, get back to you, take care of it
we/ agree, decided, committed to
we'll/ go with, handle it, address this
that/ worked, fixed it, is right, makes sense, is correct
that's/ right, correct, exactly it
you are/ right, correct
you're/ right, correct
fair point/.
good point/.
great point/.
valid point/.
excellent point/.
key/ point, takeaway
main takeaway/.
important point/.
the point is/.
bottom line/.
heads up/.
well said/.
spot on/.
all sorted/.
works now/.
what i/ mean is, meant is
what i'm saying is/.
to/ clarify, be clear
let me rephrase/.
in other words/.
more precisely/.
makes sense to me/.
this/ matters, is important
worth/ noting, remembering
keep in mind/.
bear in mind/.
note this/.
noted/.
make note of this/.
take note/.
don't forget/.
remember this/.
pay attention to this/.
acknowledged/.
confirmed/.
deadline/.
agreed to/.
time-sensitive/.
top priority/.
high priority/.
final/ answer, decision
decision made/.
it was decided/.
issue resolved/.
problem solved/.
exactly right/.
absolutely right/.
"""
_NEGATE = """
i/ misspoke, disagree, was wrong, made a mistake, take that back
my/ bad, mistake
that/ failed, is wrong, didn't work, doesn't work, is not right, is not correct
that's/ wrong, not right, not correct
you are wrong/.
you're wrong/.
still/ broken, not working
skip that/.
cancel that/.
forget/ that, what i said
ignore/ that, my last
scratch/ that, what i said
retract that/.
never mind/ ., that
nevermind/.
nvm/.
disregard/.
incorrect/.
irrelevant/.
not/ important, quite right
beside the point/.
doesn't matter/.
it doesn't matter/.
this doesn't matter/.
to correct myself/.
wait, no/.
actually, no/.
"""


def _phrases(text: str) -> tuple[str, ...]:
    out = []
    for line in text.strip().splitlines():
        head, tails = line.split("/")
        if tails.strip() == ".":
            out.append(head)
        else:
            out += [head if t.strip() == "." else f"{head} {t.strip()}" for t in tails.split(",")]
    return tuple(out)


AFFIRMATIONS, NEGATIONS = _phrases(_AFFIRM), _phrases(_NEGATE)
