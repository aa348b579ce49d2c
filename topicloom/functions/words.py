"""Word lists for the content filters. They are parameters: pass a ``Lists`` of your own for another corpus."""

from __future__ import annotations

from dataclasses import dataclass

_NAMES = "adam alan alex alice amy andrea andrew angela anna anne anthony barbara ben betty bob brian carl carol charles chris claire daniel david diana donald dorothy edward elena elizabeth emily emma eric eva frank george grace hannah harry helen henry jack jacob james jane jason jennifer jessica joan john joseph julia karen kate kevin laura linda lisa louis lucas lucy maria mark martin mary matthew max michael michelle mike nancy nick oliver olivia oscar patricia paul peter rachel rebecca richard robert ruth sam samuel sarah scott simon sophia stephen steven susan thomas tim tom victor victoria walter william"
_FILLER = "please help|thank you|let me know|of course|for example|in conclusion|best practice|best practices|step by step|key point|key points|following example|additional information|more information|further assistance|language model|ai language model|open source|good luck|feel free|hope this helps|great question|scalable design"
_NOISE = "value values thing things way ways time times example examples number numbers part parts type types kind kinds name names list lists point points case cases fact facts line lines word words text item items user users result results question questions answer answers"
_GEO = "london paris berlin madrid rome tokyo moscow beijing delhi sydney america england france germany spain italy japan russia china india australia canada brazil mexico africa asia europe"
_FICTION = "wizard dragon elf elves dwarf goblin vampire werewolf kingdom knight sorcerer magic spell prophecy quest"
_STOP = "the and for are but not you all any can had her was one our out has his how its who did get may new now see two way use with that this have from they will would there their what about which when make like time just know take into year your good some could them other than then look only come over think also back after work first well even want because these give most"


@dataclass(frozen=True)
class Lists:
    names: tuple[str, ...] = tuple(_NAMES.split())
    filler: tuple[str, ...] = tuple(_FILLER.split("|"))
    filler_patterns: tuple[str, ...] = (r"^(please|kindly) ", r"^(sure|certainly|absolutely)\b", r"\b(as an ai|i am an ai)\b", r"^(here is|here are|this is) ", r" (of|for|to|in)$")
    strict_patterns: tuple[str, ...] = (
        r"^(please|kindly)\b", r"^(sure|certainly|absolutely)\b", r"\b(as an ai|i am an ai)\b", r"^(here is|here are|this is|there are)\b", r" (of|for|to|in|and|or|the|a)$",
        r"^(i|you|we|they|it) ", r"^(let me|let us|feel free|make sure)\b", r"\b(hope|happy|glad) (this|that|to)\b", r"^(can|could|would|will|should) (you|i|we)\b", r"^(step|part|point|option|question|answer) [0-9]+$",
    )
    noise: tuple[str, ...] = tuple(_NOISE.split())
    geo: tuple[str, ...] = tuple(_GEO.split())
    fiction: tuple[str, ...] = tuple(_FICTION.split())
    stop: tuple[str, ...] = tuple(_STOP.split())


DEFAULT = Lists()
#: A second word that ends so is a topic, not a surname (fixed values).
SUFFIXES = ("ing", "tion", "ment", "ness", "ity", "ics", "ism")
