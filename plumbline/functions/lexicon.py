"""Word lists that the scores depend on; every operator takes them as parameters."""

from __future__ import annotations

# Words of waiting time, products, staff, narration and generic praise.
WAIT = "минут минута минуту час часа часов секунд неделю".split()
PRODUCTS = (
    "капучино|латте|эспрессо|раф|американо|стейк|борщ|котлет|чизкейк|десерт|пицца|суши|паста|трюфель|рибай|татар|молок|лови кофе|"
    "supplement|abonement|абонемент|тренировк|кардио|хотел|номер|wi-fi|койка|ноутбук|аккумулятор|чека|гарантия|английский|анестези|"
    "корень|зуб|снимок"
).split("|")
STAFF = "администратор|официант|бариста|врач|стоматолог|тренер|консультант|горничн|ресепшн|персонал".split("|")
NARRATIVE = (
    "потом|хотя|потому|когда|после|затем|однако|несмотря|прежде|наконец|показалось|пришлось|заказал|ждал|ждала|приехал|сходил|попросил"
).split("|")
GENERIC = (
    "всё понравилось|все понравилось|все супер|все отлично|всё отлично|рекомендую всем|лучшее место|лучше не найти|безупречно|идеально|"
    "на высоте|не передать словами|незабываемые впечатления|было волшебно|это просто супер|нет слов|не пожалеете|останетесь довольны|"
    "великолепно|восхитительно|потрясающе|top place|everything was perfect|highly recommend|love it|amazing|awesome|excellent place|"
    "замечательно|шикарно|супер|отлично|класс"
).split("|")
# Function words of English and of Russian.
STOP_EN = (
    "a about above after again against all am an and any are aren't as at be because been before being below between both but by can't "
    "cannot could couldn't did didn't do does doesn't doing don't down during each few for from further had hadn't has hasn't have haven't "
    "having he he'd he'll he's her here here's hers herself him himself his how how's i i'd i'll i'm i've if in into is isn't it it's its "
    "itself let's me more most mustn't my myself no nor not of off on once only or other ought our ours ourselves out over own same shan't "
    "she she'd she'll she's should shouldn't so some such than that that's the their theirs them themselves then there there's these they "
    "they'd they'll they're they've this those through to too under until up very was wasn't we we'd we'll we're we've were weren't what "
    "what's when when's where where's which while who who's whom why why's with won't would wouldn't you you'd you'll you're you've your "
    "yours yourself yourselves aren can couldn didn doesn don hadn hasn haven isn let ll mustn re shan shouldn ve wasn weren won wouldn"
).split()
STOP_RU = (
    "а б бы в все во вот всегда всё вы где да даже два для до его ее её если есть ещё же за зато здесь и из или им их к как какая какие какой "
    "когда конечно кто ли либо между меня мне мной много может мои моя мы на над нам нами написать написал не него нее неее ней нет ни нибудь "
    "но ну о об один одна одно он она они оно от отзыв отзывы очень по под при про раз с сам сама сами самое самом самым свой свои свою себя "
    "сегодня сейчас со собой так такая такие такой там те тебе тебя тем теперь то того тоже той только том тот тут ты у уже уж чему что "
    "чтобы эта эти это этой этим этих этот эту я"
).split()
STOP = list(dict.fromkeys(STOP_EN + STOP_RU))
