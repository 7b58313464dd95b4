"""The small labelled table that the personal-information model is trained on.

Sentences are written with slots.  A slot in braces is a mention of that kind, or (in lower case with a
leading underscore) something that only looks like one.  Every slot is filled from the lists below with a
seeded generator, so the table is the same on every run.  All fillings are invented.
"""

from __future__ import annotations

import random
from collections.abc import Callable

KINDS = ("email", "phone", "id_number", "address", "name")

# Sentences around mentions, by kind and language.  They are written for this table, out of everyday life and office work.
SENTENCES = """
{ja_name}さんの席は窓ぎわです。|きのう{ja_name}さんと駅で会いました。|鍵は{ja_name}さんが持っています。|{ja_name}様あてに小包が届きました。|{ja_name}様、お待たせいたしました。|受付で{ja_name}様をお呼びください。|{ja_name}くんの宿題を見てあげてね。|そこで{ja_name}くんが手を挙げた。|{ja_name}氏は著書でこう書いている。|議事は{ja_name}氏の報告から始まった。
{ja_name}先生の講義は面白い。|担当は{ja_name}です。|{ja_name}が担当になった。|これは{ja_name}が直した。|それなら{ja_name}が知っている。|{ja_name}様から花が届いた。|{ja_name}様からお電話です。|{ja_name}さんに聞いてみます。|{ja_name}さんに渡しました。|先月、{ja_name}くんが転んだ。|{ja_name}氏と意見が合わない。|診察は{ja_name}先生の番です。|{ja_name}ちゃんが歌った。|うちの班では{ja_name}が料理を作る。|運転は{ja_name}が引き受けた。|幹事は{ja_name}がやるそうです。|発表者は{ja_name}、場所は二階です。|写真を撮ったのは{ja_name}だった。|{ja_name}から電話がありました。|{ja_name}に傘を貸した。|{ja_name}と{ja_name}が同じ組です。|{ja_name}も呼びましょう。|代わりに{ja_name}さんを推薦します。|そういえば、{ja_name}さん、旅行はどうでしたか。|ええと、{ja_name}さんはまだ来ていませんよね。|新しい会長に{ja_name}を選んだ。|作者の{ja_name}は北の島で生まれた。|担任の{ja_name}先生に渡す。|窓口は{ja_name}です。|{ja_name}が案内します。|{ja_name}の件は片づいた。|書記は{ja_name}さん、会計は{ja_name}さん。|では{ja_name}部長、どうぞ。|隣の{ja_name}さんによると雨らしい。|{ja_name}殿|荷物を{ja_name}さん宅に預けた。|{ja_name}さんが風邪をひいた。|さっき{ja_name}様がお帰りになりました。|このあと{ja_name}さんが歌います。
{any_name}：おはようございます。|{any_name}: 天気がいいですね。|{any_name}：少し待ってください。|{any_name}: I will take the bus.|{any_name}： Good morning, all.|{any_name}> It rained again.|{any_name}＞犬が二匹います。|{any_name} ： 明日は休みです。|{any_name}：うーん、どうかな。|{any_name}: Wir fangen an.|{any_name}： Das Wetter ist schön.|{any_name}: Buenos días a todos.|{any_name}：早上好。|{any_name}: สวัสดีครับ|{any_name}: नमस्ते|{any_name}：「おもしろい」と祖母が言った。|{any_name}: "Too late," said the driver.|{any_name}＞ Perdone, no le oí.|{any_name}：笛を吹いて。|{any_name} : Hm, maybe.|[{any_name}] おなかがすいた。|{any_name}＞今天很冷。
電話番号は{ja_phone}です。|{ja_phone}までご連絡を。|{ja_phone}まで電話をください。|こちらの番号 {ja_phone} にかけた。|{ja_phone} にかけても出ない。|つながるのは{ja_phone}だけだ。|折り返しの電話は {ja_phone} に。|かけ直すなら{ja_phone}まで。|通じないときは {ja_phone} へかける。|連絡なら{ja_phone}がよい。|外から{ja_phone}へかける。|{ja_phone}に電話してください。|携帯は{ja_phone}、夜でも出ます。|ファックスは{ja_phone}へ流してください。|予約は{ja_phone}で受けています。|急ぐときは{ja_phone}が早いです。|{ja_phone}でつながります。|留守電を{ja_phone}に入れた。|問い合わせ先 {ja_phone}|番号が変わって{ja_phone}になった。|実家の電話が{ja_phone}だ。|えっと、{ja_phone}、です。|そこにかけるなら {ja_phone} だよ。|担当直通：{ja_phone}|受付の番号、{ja_phone}を控えて。
宛先は{email}です。|{email}に写真を送った。|{email}から返事が来た。|申込みは{email}まで。|アドレスが{email}に変わりました。|{email} へ転送してください。|請求書は{email}にお願いします。|メモ：{email}|あのー、{email}、です。|{email}あてに地図を添付しました。|控えを {email} でもらう。|署名の下に{email}と書いた。|{email}、こちらに連絡を。
マイナンバーは{ja_id}でした。|旅券の番号が{ja_id}だった。|保険証の番号が{ja_id}になる。|免許の番号が{ja_id}、と言った。|本人番号{ja_id}を確かめた。|個人番号が{ja_id}に決まった。|身分証の番号に{ja_id}を入れた。|納税者番号{ja_id}|マイナンバー（{ja_id}）を届けた。|個人番号は{ja_id}、間違いない。|本人を示す番号は{ja_id}でいいですか。|パスポートの番号が{ja_id}らしい。|免許証か旅券の番号、{ja_id}を見せた。|本人の確認に{ja_id}を使った。|確認のための個人の番号、{ja_id}を書いた。|{ja_id}が私の番号です。|パスポート番号：{ja_id}|保険証には{ja_id}とある。|免許証に{ja_id}と書いてあった。|年金の番号、{ja_id}を記入した。|身分証は{ja_id}、期限は春まで。|本人の番号として{ja_id}を受け取った。|旅券{ja_id}を提示した。|えー、{ja_id}、これが個人の番号です。|番号{ja_id}の保険証を返した。|在留カードの番号は{ja_id}だそうだ。
住まいは{ja_address}です。|{ja_address}に引っ込んだ。|家が{ja_address}なので坂が多い。|荷物の送り先に{ja_address}と書いた。|{ja_address}に店を開いた。|実家は{ja_address}にあります。|小包は{ja_address}あてに出した。|{ja_address}で降ろしてください。|{ja_address}まで歩いた。|新しい住所：{ja_address}|事務所を{ja_address}に移した。|届け先を{ja_address}にしてください。|タクシーで{ja_address}へ。|その家、{ja_address}だったよね。|登記上は{ja_address}となっている。|祖父は{ja_address}で暮らす。
{en_name} plays the cello.|Ask {en_name} for the key.|Ask {ro_name} for the key.|{en_name} was on the roof.|This seat belongs to {ro_name} as well.|I met {en_name} at the station.|My neighbour {en_name} has two dogs.|Give the keys to {en_name}, will you?|{en_name} and {en_name} share a desk.|The cake was baked by {en_name}.|This is {en_name} speaking.|Mr. {en_name} called twice.|Mrs. {en_name} is waiting outside.|Dr. {en_name} will see you at noon.|According to {en_name}, it may snow.|Did {en_name} find the cat?|Let {en_name} know.|It was {en_name} who painted the door.|We owe {en_name} a lunch.|Perhaps {en_name} can drive.|{en_name} said no.|Our new driver, {en_name}, starts in spring.|Thank you, {en_name}.|I will ask {en_name} about the boat.|Somebody saw {en_name} on the train.|As {en_name} explained, the lock is old.|With {en_name} away we are three.|The letter from {en_name} got wet.|{en_name}'s umbrella is green.|Tell {en_name} that I am late.|Nobody told {en_name}.|Photos by {en_name}|Dinner with {en_name} was fun.|um, {en_name} knows the way.|Please welcome {en_name}.
I met {ro_name} at the station.|Mr. {ro_name} called twice.|The cake was baked by {ro_name}.|Let {ro_name} know.|According to {ro_name}, it may snow.|{ro_name} plays the cello.|Perhaps {ro_name} can drive.|Herr {ro_name} spielt Klavier.|Gracias a {ro_name} llegamos.|Tell {ro_name} that I am late.
You can ring {en_phone} at night.|{en_phone} is my mobile.|Phone: {en_phone}|The hotel gave me {en_phone}, so try that.|Text {en_phone} when you land.|Fax it to {en_phone} by noon.|For repairs dial {en_phone}.|My new number, {en_phone}, works again.|Just ring up {en_phone} and wait.|He wrote {en_phone} on a napkin.|Dial {en_phone} or knock.|uh, {en_phone}, that was it.
E-mail: {email}|You can reach me via {email}.|Send the photos to {email} tonight.|{email} bounced.|Her new address is {email}.|Copy {email} on everything.|I wrote to {email} and got no answer.|The list lives at {email}.|Sign up with {email} first.|{email} is the one to use.|Forward this to {email}, thanks.|um, {email}, all in small letters.
The passport number is {en_id}.|My social security number is {en_id}.|Driving licence: {en_id}|His licence {en_id} expired in spring.|Licence {en_id} is fake.|She renewed licence {en_id} twice.|A licence, {en_id}, lay on the floor.|The passport says {en_id}.|We have no insurance number but {en_id}.|He typed {en_id} as his tax number.|Insurance card {en_id} expired.|Her identity card says {en_id}.|Passport {en_id} was lost in spring.|Enter {en_id} where it asks for your ID.|uh, the licence is {en_id}.|Your national insurance number, {en_id}, is missing here.|Under {en_id} she is insured.
We moved to {en_address} in spring.|The bakery is at {en_address}.|{en_address} is for sale.|Address: {en_address}|My aunt lives at {en_address} with a parrot.|Send the parcel to {en_address}, not to the office.|Pick me up from {en_address} at six.|They found the bike near {en_address}.|The taxi went to {en_address} first.|Home is {en_address}.|Her post goes to {en_address}.|Meet us outside {en_address}.
{de_name} spielt Klavier.|Bitte {de_name} anrufen.|Bitte sag {de_name} nichts.|Bitte {ro_name} anrufen.|Gestern kam {de_name} zu spät.|Der Schlüssel liegt bei {de_name}.|Frau {de_name} hat Geburtstag.|Herr {de_name} wartet unten.|Der Kuchen ist von {de_name}.|Kennst du {de_name}?|Sag {de_name} Bescheid.|Mit {de_name} zusammen sind wir vier.|Laut {de_name} schneit es bald.|{de_name} und {de_name} teilen sich ein Zimmer.|Dann hat {de_name} angerufen.|Hallo, hier spricht {de_name}.|Fragen wir doch {de_name} danach.|Dr. {de_name} ist im Urlaub.|Meine Nachbarin {de_name} hat zwei Hunde.|Ich habe {de_name} gesehen.
Die Telefonnummer ist {de_phone}.|Ruf mich unter {de_phone} an.|{de_phone} ist besetzt.|Fax: {de_phone}|Seine neue Nummer {de_phone} geht wieder.|Wählen Sie {de_phone} und warten Sie.|Der Reisepass hat die Nummer {en_id}.|Mein Führerschein: {en_id}|Die Steuernummer {en_id} fehlt.|Wir wohnen {de_address} im dritten Stock.|Der Bäcker ist {de_address} links.|Adresse: {de_address}|Das Paket ging an {de_address} zurück.|Treffpunkt {de_address} um sechs.|Sie zieht nach {de_address} um.|Schreib mir an {email}.|Die Fotos gehen an {email} heute Abend.|Meine Adresse lautet {email}.|E-Mail: {email}
{es_name} toca la guitarra.|Ayer vi a {es_name} en la estación.|La llave la tiene {es_name}.|La señora {es_name} espera fuera.|El señor {es_name} llamó dos veces.|Don {es_name} vendió la casa.|Según {es_name}, va a nevar.|Dile a {es_name} que llego tarde.|{es_name} y {es_name} comparten mesa.|La tarta es de {es_name}.|Gracias a {es_name} llegamos.|Mi vecina {es_name} tiene dos perros.|Soy {es_name}, buenas tardes.|El móvil de casa es {es_phone} desde mayo.|Marca el {es_phone} y espera.|{es_phone} no contesta.|Teléfono: {es_phone}|Me dio el {es_phone} en una servilleta.|Se puede llamar al {de_phone} de noche.|El pasaporte lleva el número {es_id}.|Su carné dice {es_id}.|DNI: {es_id}|Su documento, {es_id}, caducó.|Documento: {es_id}|El número del documento es {es_id}.|Perdió el documento {es_id} en el tren.|Con el número {es_id} está asegurada.|La panadería está en {es_address}.|Nos mudamos a {es_address} en primavera.|Vive en {es_address} desde ayer.|Vivimos en {es_address} por fin.|Dirección: {es_address}|El paquete volvió de {es_address} ayer.|Recógeme en {es_address} a las seis.|Manda las fotos a {email} esta noche.|Mi correo es {email}.|Correo: {email}|{email} no funciona.
{zh_name}会弹钢琴。|有事找{zh_name}。|请找{zh_name}签字。|门口有人找{zh_name}。|昨天在车站见到{zh_name}了。|钥匙在{zh_name}那里。|{zh_name}先生来电话了。|请{zh_name}女士到前台。|{zh_name}老师今天休息。|蛋糕是{zh_name}做的。|告诉{zh_name}我晚点到。|{zh_name}和{zh_name}坐一起。|听{zh_name}说要下雪。|我是{zh_name}，您好。|谢谢{zh_name}。|麻烦你叫一下{zh_name}。|让{zh_name}去吧，他认识路。|去问{zh_name}，他都知道。|我想找{zh_name}聊聊。|{zh_name}：早上好。|{zh_name}说不行。
手机号是{zh_phone}。|打{zh_phone}找我。|打给{zh_phone}。|拨打{zh_phone}即可。|给{zh_phone}打电话。|电话号码{zh_phone}。|你先打{zh_phone}问问。|身份证号码是{zh_id}。|证件号码是{zh_id}。|我的身份证号：{zh_id}|身份证上写着{zh_id}。|办理时填了{zh_id}。|身份证号：{zh_id}，没错。|请拨{zh_phone}。|{zh_phone}没人接。|联系电话：{zh_phone}|你可以打{zh_phone}找我。|传真发到{zh_phone}。|护照号码{zh_id}。|他的证件号：{zh_id}|身份证{zh_id}丢了。|号码{zh_id}是我的身份证。|我们搬到{zh_address}了。|地址：{zh_address}|面包店在{zh_address}。|包裹退回{zh_address}了。|她住{zh_address}，离这儿不远。|我在{zh_address}等你。|请把信送到{zh_address}。|照片发给{email}。|我的邮箱：{email}|{email}收不到信。|请写信到 {email} 。|老家在{zh_address}。
""".strip().replace("\n", "|").split("|")

# Sentences put together from parts: what is told, how, and what follows; each several times, as each stands for many.
SENTENCES += 3 * """
{_idword}{_link}{ja_id}{_tail}|{_lead_ja}、{_idword}{_link}{ja_id}{_tail}|{_phword}{_link}{ja_phone}{_tail}|{_lead_ja}、{_phword}{_link}{ja_phone}{_tail}|{_adword}{_link}{ja_address}{_tail}|{_emword}{_link}{email}{_tail}|{_phword}{_link} {ja_phone} {_tail}|{_emword}{_link} {email} {_tail}
{ja_name}{_hon}{_act}|{ja_name}{_hon}{_act}|{_n}は{ja_name}{_hon}{_act}|{_lead_ja}、{ja_name}{_hon}{_act}|{_role}は{ja_name}{_tail}|{_role}の{ja_name}{_act}|{ja_name}{_ga}|{_n}を{ja_name}{_ga}|それは{ja_name}{_ga}|{ja_name}{_hon}、{_n}はどうですか。|{_role}、{ja_name}{_hon}|{_n}の件は{ja_name}に{_n}を渡した。|{_lead_ja}、{ja_name}{_ga}
{_lead_en}, {_idword_en} {_link_en} {en_id}{_tail_en}|{_idword_en} {_link_en} {en_id}{_tail_en}|{_phword_en} {_link_en} {en_phone}{_tail_en}|{_adword_en} {_link_en} {en_address}{_tail_en}|{_emword_en} {_link_en} {email}{_tail_en}|{en_name} {_did} the {_e}.|The {_e} {_link_name} {en_name}{_tail_en}|{_verb} {en_name}{_tail_en}|{_verb} {ro_name}{_tail_en}|{_lead_en}, {en_name} {_did} the {_e}.|{ro_name} {_did} the {_e}.
{_idword_zh}{_link_zh}{zh_id}{_tail_zh}|{_phword_zh}{_link_zh}{zh_phone}{_tail_zh}|{_adword_zh}{_link_zh}{zh_address}{_tail_zh}|{_before_zh}{zh_name}{_after_zh}|{zh_name}{_after_zh}|{_emword_zh}{_link_zh}{email}{_tail_zh}
{_idword_de} {_link_de} {en_id}{_tail_de}|{_phword_de} {_link_de} {de_phone}{_tail_de}|{_verb_de} {de_name}{_tail_de}|{de_name} {_did_de}.|{_adword_de} {de_address}{_tail_de}
{_idword_es} {_link_es} {es_id}{_tail_es}|{_phword_es} {_link_es} {es_phone}{_tail_es}|{_verb_es} {es_name}{_tail_es}|{es_name} {_did_es}.|{_adword_es} {es_address}{_tail_es}
""".strip().replace("\n", "|").split("|")

# Sentences without any mention, and with what only looks like one.
PLAIN = """
{_room}号室の窓が開いている。|受付番号{_slip}の方、どうぞ。|お荷物の追跡番号は{_order}です。|部品{_part}が足りない。|{_date}は休館日です。|{_time}は昼休みになります。|伝票の{_order}を探している。|{_ticket}の札を付けた箱がある。|@all 全員集合です。|気温は12.5度まで下がった。|全部で1,280円になります。|第3章の42ページを開いて。|{_topic_ja}が届いた。|{_topic_ja}を{_group}に頼んだ。|{_topic_ja}はまだ冷たい。|きのう、{_topic_ja}の夢を見た。|{_group}の人が{_topic_ja}を運んだ。|{_topic_ja}の値段が倍になった。|雨が降ってきた。|もう寝ましょう。|それはいい考えですね。|ちょっと待って。|どういたしまして。|賛成です！|参加者A：{_topic_ja}はどこですか？|発言者3：右です。|株式会社{_firm_ja}の看板が見える。|{_firm_ja}株式会社：ご来店ありがとうございます。|（株）{_firm_ja}に就職した。|{_firm_ja}さんの商品は丈夫だ。|「{_topic_ja}はいらない」と祖母が言った。|体重が2.4キロ増えた。|{_date}から{_date}まで旅に出る。|試合は3-2で終わった。|午後{_time}のあいだ閉めます。|議長はいません。|部長が笑った。|先生、質問があります。|お客様がお待ちです。|皆さん、静かに。|店長に聞いた。|{_room}の棚に置いた。|型式{_part}、色は青。|図書カード{_slip}を拾った。|{_ticket}番の抽選に当たった。|5月3日の{_time}に集まる。|うーん、わかりません。|えーと、{_topic_ja}、ですかね。
Room {_room} smells of paint.|Your parcel {_order} is on its way.|Tracking number {_order} does not exist.|Receipt {_slip} is for shoes.|We are out of part {_part}.|Closed on {_date} for cleaning.|The shop opens {_time} in winter.|Box {_ticket} is empty.|Thanks @all for coming.|The {_topic_en} arrived wet.|Who ate the {_topic_en}?|The {_topic_en} belongs to {_group_en}.|Ask {_group_en} about the {_topic_en}.|It was 12.5 degrees on {_month} 7.|We leave on {_month} 21 and return in {_month}.|In {_month} the {_topic_en} costs twice as much.|That makes $1,280.50 in all.|See chapter 3, page 42.|The match ended 3-2.|"I want a {_topic_en}," said the driver.|Participant A: Maybe.|Speaker 2: Left, then right.|{_firm_en} Ltd. sells boats.|{_firm_en} Inc.: Thank you for calling.|I bought it from {_firm_en}, I think.|Fine by me.|No idea.|Good night!|That is so kind of you.|The driver was late again.|My mother likes the {_topic_en}.|Bus 42 goes to the harbour.|Flight {_ticket} is late.|um, I forgot the {_topic_en}.|Version 12.3 is faster.|The doctor smiled.|Everybody laughed.|Our {_topic_en} is 22 percent lighter, at last.|On Monday the {_topic_en} was gone.|Does the {_topic_en} fit in Row 5?|The road was long and the street was dark.|Way too many people came.|Seat 14 B is taken.|He counted one two three and jumped.|Ninety people sang.
Zimmer {_room} ist frei.|Ihr Paket {_order} ist unterwegs.|Beleg {_slip} gilt für Schuhe.|Am {_date} bleibt es zu.|Kiste {_ticket} ist leer.|Die {_topic_de} ist nass.|Wer hat den {_topic_de} gegessen?|Das {_topic_de} kostet 12,50 Euro.|Frau Doktor, bitte warten.|Der Fahrer kam zu spät.|Am 12. Mai regnet es, z. B. nachts.|Mir egal.|Gute Nacht!|Ganz ehrlich: der {_topic_de} schmeckt nicht.|Die {_topic_de} gehört uns, Nr. 42 auch.|äh, ich weiß nicht.|Montag kommt die {_topic_de}.|Neues vom {_topic_de}: nichts.|Die Straße war lang.|Wir zählten 310 Vögel.
La habitación {_room} está libre.|Su paquete {_order} está en camino.|El recibo {_slip} es de zapatos.|Cerrado el {_date}.|La caja {_ticket} está vacía.|El {_topic_es} llegó mojado.|La {_topic_es} cuesta 12,50 euros.|¿Quién se comió el {_topic_es}?|El conductor llegó tarde, pág. 42.|Me da igual.|¡Buenas noches!|La calle era larga.|El médico sonrió.|este, no sé.|Contamos 310 pájaros el 12 de mayo.
{_room}房间空着。|您的包裹{_order}在路上。|收据{_slip}是买鞋的。|{_date}不开门。|箱子{_ticket}是空的。|{_topic_zh}湿了。|谁把{_topic_zh}吃了？|{_topic_zh}要12.5元。|司机又迟到了。|老师，我有问题。|晚安！|随便。|“我不要{_topic_zh}。”奶奶说。|第42页第3章。|我们数了310只鸟。|呃，我忘了。|经理笑了。|大家都唱歌。|今天12度。|{_topic_zh}在第7排。|发言人2：往左。
วันนี้อากาศดีมากครับ|รถเมล์มาสายสิบนาทีค่ะ|ขอบคุณทุกคนที่มา 20 คน|มีกล่องเปล่า 12 ใบ|आज मौसम अच्छा है।|बस दस मिनट देर से आई।|हमने 310 चिड़ियाँ गिनीं।|दुकान 12 बजे खुलती है।
""".strip().replace("\n", "|").split("|")

# Ordinary sentences of common words, so that the field sees much that is no mention.
PLAIN += """
{_n}を{_n}に変えました。|{_n}について話し合います。|{_n}の{_n}が足りません。|{_n}は{_num}件になりました。|{_n}と{_n}の違いを説明します。|もう一度{_n}を見直します。|{_n}が{_num}人に増えました。|{_n}を{_g}が引き受けます。|{_n}は{_g}から聞きました。|{_g}で{_n}を準備します。|{_g}の{_n}が遅れています。|{_g}と{_g}が相談します。|{_n}に{_num}分かかります。|{_n}の見通しは明るいです。|{_n}を{_num}円で買いました。|{_n}はどうしましょうか。|{_n}も忘れずに。|まず{_n}、それから{_n}です。|{_n}が終わったら{_n}へ進みます。|{_n}のせいで{_n}が止まりました。|{_n}を使って{_n}を調べます。|{_n}に詳しい人はいますか？|{_n}ができました！|{_n}は{_date}に始まります。|{_n}は{_month_n}月{_num}日です。|{_n}のほうが{_n}より安い。|「{_n}が先だ」と言われました。|「{_n}はまだです。」と{_g}が答えた。|{_n}によると{_n}が{_num}％下がった。|{_lead_ja}、{_n}を確認します。|{_lead_ja}、{_n}の{_n}です。|{_lead_ja}：{_n}を続けます。|{_n}が多すぎませんか。|{_n}、{_n}、{_n}の順に並べる。|それでは{_n}を閉じます。|{_n}を第{_num}回に回す。|{_n}は{_num}ページに載っています。|製品の番号は{_order}です。|座席の番号は{_order}です。|出荷番号は{_order}、明日届く。|管理番号{_order}で探す。|教室{_room}に集合。|会議室{_room}を予約した。|予約番号が{_order}だった。|注文{_order}を発送した。|注文番号は{_order}。|注文番号{_order}が見つからない。|注文番号{_order}を取り消した。|注文の番号{_order}を確認中。|請求番号{_order}|受注番号{_order}は変更なし。|発注番号{_order}に替える。|注文番号 {_order} の箱。|請求書{_slip}を直した。|製造番号{_order}を控えた。|部品番号{_part}に替えた。|問い合わせ番号{_ticket}が発行された。|{_n}に{_room}を使う。|{_n}、{_num}番目の{_n}です
{_e} and {_e} need work.|The {_e} changed the {_e}.|We talked about the {_e}.|There are {_num} {_e}s left.|{_lead_en}, the {_e} is late.|{_lead_en}: the {_e} again.|{_lead_en}, {_group_en} will take the {_e}.|Is the {_e} better than the {_e}?|"The {_e} comes first," they said.|It took {_num} minutes to fix the {_e}.|Please check the {_e} on {_date}.|The {_e} starts on {_month} {_num}.|Most of the {_e} was fine, more or less.|{_e} costs went up by {_num} percent.|Invoice {_order} covers the {_e}.|Order number {_order} was cancelled.|Serial number {_order} is on the {_e}.|Ticket {_ticket} is about the {_e}.|Part number {_part} fits.|See page {_num} for the {_e}.|Can we move the {_e} to {_month}?|I think the {_e} works now.|Not the {_e}, the {_e}.|Everyone liked the {_e}, U.S. guests too.|The new {_e} has {_num} seats.|Version {_num}.{_num} of the {_e} is out.
{_d} und {_d} fehlen noch.|Die {_d} ist fertig.|Der {_d} kostet {_num} Euro.|Das {_d} dauert {_num} Minuten.|{_lead_de}, die {_d} kommt später.|{_lead_de}: der {_d} braucht z. B. noch {_num} Teile.|{_lead_de}: das {_d} steht unter {_ticket}.|Wir reden über die {_d}.|„Die {_d} zuerst“, hieß es.|Ist der {_d} besser als die {_d}?|Die {_d} für den {_d} ist um {_num} Prozent teurer.|Bestellung {_order} ist storniert.|Rechnung {_slip} gehört zur {_d}.|Am {_num}. Mai beginnt die {_d}.
La {_s} y el {_s} faltan.|El {_s} cuesta {_num} euros.|La {_s} tarda {_num} minutos.|{_lead_es}, la {_s} llega tarde.|{_lead_es}: el {_s} está listo.|Hablamos de la {_s}.|¿Es mejor el {_s} que la {_s}?|El pedido {_order} se canceló.|La factura {_slip} es del {_s}.|El {_s} empieza el {_num} de mayo.|La {_s} de la {_s} aparece en la pág. {_num}.|Hay {_num} plazas para el {_s}.
{_z}和{_z}还不够。|我们讨论{_z}。|{_z}要{_num}天。|{_z}增加了{_num}个。|{_lead_zh}，{_z}晚了。|{_lead_zh}：{_z}继续。|{_z}比{_z}便宜{_num}元。|{_z}大概{_num}分钟做完！|“{_z}最重要。”他们说。|请检查{_z}的{_z}。|{_z}在第{_num}页。|订单{_order}已取消。|发票{_slip}是{_z}的。|{_z}交给{_gz}。|{_gz}负责{_z}吗？|{_z}从{_num}月开始，第{_num}周结束。|{_z}平均{_num}.{_num}秒。|没有{_z}就没有{_z}。|编号{_ticket}是{_z}。
""".strip().replace("\n", "|").split("|")

PLAIN += 4 * """
{_noword}{_link}{_order}{_tail}|{_noword}{_link}{_slip}{_tail}|{_noword_en} {_link_en} {_order}{_tail_en}|{_noword_zh}{_link_zh}{_order}{_tail_zh}|{_noword}{_order}{_tail}|{_noword}{_ticket}{_tail}|{_noword}は{_ticket}{_tail}|会議室{_room}{_tail}|{_noword_en} {_ticket}{_tail_en}|{_noword_en} {_slip}{_tail_en}|{_noword_en} {_order} {_did_it}.|{_n}{_act}|{_n}{_act}|{_g}{_act}|{_g}{_ga}|{_n}{_ga}|「{_n}{_act}」と{_g}が言う。|{_role}{_act}|{_role}は{_n}{_tail}|{_before_zh}{_gz}{_after_zh}|{_verb} the {_e}{_tail_en}
""".strip().split("|")

#: What may stand before a sentence: hesitations, notes of sounds and clock stamps.
LEADS = ("ええと ", "えーと ", "あの ", "うーん ", "んー、", "em ", "äh ", "[BLANK_AUDIO] ", "[noise]", "(laughs) ", "【笑い声】", "*coughs* ", "（笑）", "えー、", "あのー、", "ええと、", "um, ", "uh, ", "ähm, ", "este… ", "呃，", "(笑)", "[music] ", "（拍手）", "00:01:02 - ", "[12.5] ", "(00:12) ", "♪ ", "・", "- ", "「", "* ")

_W = {
    # Common words of the languages, to fill ordinary sentences with.
    "idword": "旅券 パスポート 免許証 運転免許 保険証 健康保険 身分証 身分証明書 マイナンバー 個人番号 在留カード 年金手帳 本人の番号 本人番号 住民票 納税者番号 本人確認番号 旅券番号 保険の番号 免許の番号 基礎年金番号",
    "phword": "電話 電話番号 携帯 連絡先 ファックス 直通 代表番号 受付 内線 自宅の電話 職場の電話 緊急の連絡先 店の番号 折り返し先 問い合わせ先", "adword": "住所 届け先 自宅 実家 勤め先 会場 事務所 宛先 本籍 送付先 引っ越し先 納品先 新居 倉庫", "emword": "メール アドレス 宛先 連絡先 送信先 返信先 窓口 メールアドレス 転送先",
    "link": "は が の番号は 番号が 、 ： として には で は、 が、 を", "tail": "です。|でした。|と書いた。|を控えた。|で登録しておく。|、期限は春まで。|らしい。|を受け取った。|をなくした。|を見せた。|のはずだ。|と聞いた。|を確認した。|に間違いない。|だそうです。|、以上です。|にしてください。|へお願いします。|になりました。|まで。|だよ。|に変えた。||と伝えて。",
    "hon": "さん さん さん 様 さま くん 氏 先生 ちゃん", "role": "幹事 司会 書記 議長 作者 発表者 担任 窓口 運転手 代表 店長 会長 監督 主役 講師 大家 部長 課長 社長 主任",
    "act": "が来ました。|に会った。|へ渡す。|から聞いた。|は留守です。|も賛成した。|と話した。|の番です。|を待とう。|が歌う。|に任せる。|の意見です。|は休暇中。|が転んだ。|を呼ぶ。|のおかげだ。|に頼みます。|は元気そうだ。|が引っ越した。|には内緒で。|がやるそうです。|から連絡があった。|にお願いしたい。|が決めます。|に見てもらう。|は来週戻る。|によろしく。|が持っている。|をお呼びください。|が間違えた。",
    "ga": "がやるそうです。|が引き受けた。|が決めた。|が見ています。|が直した。|が来る。|が当番です。|が書いた。|が運ぶ。|がまとめる。|が説明する。|が持っている。",
    "idword_en": "her passport|his passport|my licence|the driving licence|the insurance number|my tax number|the national ID|her identity card|social security number|the ID card|your licence number|passport no.", "phword_en": "the number|my mobile|her phone|the office line|the fax|his cell|the hotline|the front desk|my landline", "adword_en": "the address|her flat|his house|the parcel went to|we live at|the party is at|my office is at|drop it off at", "emword_en": "the mail|my address|her inbox|the contact|write to|reply to|the mailbox|cc",
    "link_en": "is was says reads : = , now stays became", "tail_en": ".|, I think.| since spring.| for now.|, as far as I know.|, right?| again.|!|| and nothing else.| by noon.| instead.| tomorrow.| or not.", "did": "lost fixed bought painted wanted forgot sold moved cleaned broke ordered hated", "did_it": "got lost|came late|is wrong|was paid|is open|went out", "link_name": "came from|goes to|was for|belongs with|is with|was made by|annoyed|helped|needs", "verb": "Call|Ask|Tell|Invite|Wake|Follow|Thank|Join|Help|Meet|Greet|Remind|Trust|Watch",
    "idword_zh": "护照 身份证 驾照 社保卡 证件 身份证号 护照号码 居民身份证 我的证件号 社保号", "phword_zh": "手机 电话 联系方式 传真 座机 热线 前台电话 打 拨 打给", "adword_zh": "地址 住址 家 公司 收件地址 寄到 送到 搬到 住在 老家", "emword_zh": "邮箱 邮件 发给 抄送 回复 电子邮件", "link_zh": "是 ： 为 是： 改成 ，", "tail_zh": "。|，没错。|就可以。|，记一下。|了。||吧。|，谢谢。|！|丢了。|。没问题。",
    "before_zh": "请 告诉 找 问 叫 通知 感谢 等 听 和 给 让 麻烦 感谢 联系 我是", "after_zh": "。|来了。|签字。|女士到前台。|先生说不行。|老师今天在。|吗？|帮忙。|负责。|还没到。|去了。|做的。|知道。|，谢谢。|开会。|，好吗？|也同意。",
    "idword_de": "Mein Führerschein|Der Reisepass|Die Steuernummer|Der Ausweis|Ihre Versicherungsnummer|Die Passnummer", "phword_de": "Die Nummer|Mein Handy|Das Büro|Telefon|Das Fax|Der Anschluss", "link_de": "ist lautet : war hat heißt", "tail_de": ".| seit Mai.|, glaube ich.| bitte.| zurück.|!|| noch.", "verb_de": "Ruf Frag Grüß Hol Kennst Sag Bitte Mit Für Von Ohne", "did_de": "kommt später|ist krank|hat Urlaub|ruft an|weiß es|wartet|lacht|zieht um|schreibt", "adword_de": "Wir wohnen|Adresse:|Das Haus steht|Treffpunkt ist|Lieferung an|Er wohnt in|Sie zog nach",
    "idword_es": "El pasaporte|Mi carné|El documento|El DNI|La licencia|Su número fiscal", "phword_es": "El número|Mi móvil|El fijo|La oficina|El fax|La centralita", "link_es": "es : era dice lleva tiene", "tail_es": ".| desde mayo.|, creo.| por favor.| otra vez.|!|| todavía.| luego.", "verb_es": "Llama a|Pregunta a|Dile a|Saluda a|Con|Para|De|Según|Ayuda a|Espera a", "did_es": "llega tarde|está enfermo|tiene vacaciones|llama luego|lo sabe|espera|se ríe|se muda|escribe", "adword_es": "Vivimos en|Dirección:|La casa está en|Quedamos en|Envío a|Se mudó a",
    "noword": "注文番号 伝票番号 請求書 追跡番号 製造番号 部品番号 予約番号 管理番号 問い合わせ番号 受注番号 商品番号 発注番号 整理番号 注文 請求番号 納品書 見積番号 口座番号 会議番号", "noword_en": "order|invoice|the order number|tracking number|receipt|serial number|part|booking|ticket|the shipment|purchase order|quote|job number|batch|Order|Invoice|Parcel|Shipment", "noword_zh": "订单号 发票号 快递单号 编号 订单 发票 零件号 预约号 序列号",
    "noun_ja": "会議 予算 計画 資料 仕事 問題 時間 場所 電車 天気 料理 音楽 映画 写真 学校 病院 図書館 市場 工場 農家 道路 建物 機械 部品 商品 値段 注文 契約 保険 税金 給料 休暇 旅行 切符 荷物 手紙 新聞 雑誌 小説 辞書 教室 授業 宿題 試験 結果 原因 理由 方法 手順 規則 法律 政治 経済 歴史 地理 科学 技術 研究 実験 調査 報告 発表 質問 回答 意見 提案 決定 変更 修理 点検 掃除 洗濯 買物 散歩 運動 競技 選手 監督 観客 舞台 衣装 照明 録音 放送 番組 記事 見出し 編集 印刷 製本 配達 倉庫 在庫 出荷 返品 交換 保証 品質 検査 測定 温度 湿度 水道 電気 燃料 空気 環境 森林 河川 海岸 動物 植物 野菜 果物 牛乳 砂糖 食事 朝食 弁当 食堂 台所 玄関 廊下 階段 屋上 駐車場 受付 窓口 改札 空港 港湾 船便 航路 経路 地図 案内 通訳 翻訳 字幕 文章 用語 名簿 予定 日程 期限 締切 進捗 担当 責任 権限 安全 避難 訓練 防災 消防 警備 健康 診断 治療 手術 看護 介護 福祉 教育 育児 人事 採用 面接 研修 評価 昇給 退職 営業 広告 宣伝 販売 仕入 経費 売上 利益 損失 借入 投資 株価 為替 貿易 輸入 輸出 関税 外交 条約 選挙 投票 議会 委員会 審査 承認 申請 許可 登録 更新 削除 追加 集計 分析 設計 開発 試作 量産 改良 運用 監視 障害 復旧 移行 導入 設定 接続 通信 回線 端末 画面 鍵盤 配線 電池 充電 音声 映像 画像 文字 数字 記号 色彩 形状 材料 木材 鉄鋼 硝子 布地 包装 容器 廃棄 回収 再利用 新人 全員 来客 社員 学生 住民 委託 外部 内部 前回 次回 今回 本日 来週 先月 年度 後半 午前 夕方 深夜",
    "kata": "テーブル カメラ レンズ ノート ペン ドア ベランダ エレベーター バス トラック タクシー ホテル レストラン メニュー スープ サラダ パン チーズ ワイン コーヒー ケーキ アイス セーター コート ブーツ ボタン ポケット データ ファイル フォルダ サーバー ネットワーク プログラム テスト エラー ログ コード メモリ ディスク プリンター モニター マイク スピーカー ケーブル バッテリー センサー モーター ポンプ バルブ パイプ タンク ボルト プラン コスト リスク スケジュール イベント アンケート ポスター パンフレット ホームページ キャンペーン セミナー プロジェクト マニュアル レポート サービス システム バージョン リスト グラフ ページ スタッフ メンバー リーダー クラス コース レベル ゲーム スポーツ プール スキー ピアノ ギター コンサート ニュース ドラマ アルバム",
    "unit": "課 係 部 室 班 局 チーム グループ 委員会 支店 支部 本部 窓口 事務局 センター 担当",
    "lead_ja": "まとめると 結論として 次に 最後に 最初に 念のため 実は 確かに たとえば つまり ところで 逆に 要点 補足 議題 メモ 質問 なお また それから さて では とりあえず 同様に 一般に 当然 残念ながら 幸い 今のところ 個人的には",
    "noun_en": "meeting budget plan report kitchen garden window engine ticket contract lesson concert harbour bridge river market machine printer camera cable battery screen server network file form letter parcel invoice shelf carpet ladder hammer bottle blanket jacket helmet bicycle tractor engine airport station platform timetable menu recipe sauce cheese apple lemon salad bread coffee teacup candle mirror pillow curtain picture novel chapter exam teacher doctor nurse driver farmer baker tailor painter customer visitor student resident supplier warehouse factory office branch team committee survey interview training safety schedule deadline quality price discount refund warranty version release backup password manual translation caption recording microphone speaker subtitle summary agenda minute proposal decision question answer idea mistake reason result weather summer winter morning evening weekend holiday",
    "adj_en": "new old small large blue green broken cheap quiet second final weekly annual local whole next early heavy simple public",
    "lead_en": "Anyway|In short|By the way|Also|However|First|Second|Finally|To sum up|Note|Agenda|Question|For example|Honestly|In general|So far|Luckily|Meanwhile|After that|As before|Once more|Otherwise|Then|Besides|In the end|One more thing|Reminder|Action",
    "noun_de": "Sitzung Haushalt Planung Bericht Küche Garten Fenster Motor Fahrkarte Vertrag Unterricht Konzert Hafen Brücke Markt Maschine Drucker Kamera Kabel Bildschirm Rechner Netz Datei Formular Brief Rechnung Regal Teppich Leiter Flasche Decke Jacke Fahrrad Flughafen Bahnhof Fahrplan Speisekarte Brot Kaffee Spiegel Vorhang Roman Prüfung Lehrer Arzt Fahrer Kunde Lager Werk Büro Abteilung Ausschuss Umfrage Schulung Sicherheit Frist Qualität Preis Rabatt Garantie Fassung Übersetzung Aufnahme Mikrofon Zusammenfassung Vorschlag Frage Antwort Wetter Sommer Wochenende Auswertung Lieferung Wartung Heizung Anmeldung",
    "lead_de": "Kurzum|Nebenbei|Außerdem|Zuerst|Zuletzt|Ehrlich gesagt|Zum Beispiel|Notiz|Frage|Im Grunde|Bisher|Zum Glück|Danach|Wie immer|Anders gesagt|Noch eins|Hinweis|Wichtig ist|Kurz und gut|Dazu kommt|Dazu gilt|Dabei bleibt es|Sonst noch|Darüber hinaus gilt|Nur so viel|Fest steht|Zur Sache",
    "noun_es": "reunión presupuesto plan informe cocina jardín ventana motor billete contrato clase concierto puerto puente mercado máquina impresora cámara cable pantalla red archivo formulario carta factura alfombra escalera botella manta chaqueta aeropuerto estación horario menú pan café espejo cortina novela examen cliente almacén fábrica oficina encuesta formación seguridad plazo calidad precio descuento garantía versión traducción grabación micrófono resumen propuesta pregunta respuesta tiempo verano entrega calefacción",
    "lead_es": "En resumen|Por cierto|Además|Primero|Por último|La verdad|Por ejemplo|Nota|Pregunta|En general|Hasta ahora|Por suerte|Después|Como siempre|Otra cosa|Aviso",
    "noun_zh": "会议 预算 计划 报告 厨房 花园 窗户 发动机 车票 合同 课程 音乐会 港口 大桥 市场 机器 打印机 相机 电缆 电池 屏幕 服务器 网络 文件 表格 信件 包裹 地毯 梯子 瓶子 毯子 外套 自行车 机场 车站 时刻表 菜单 面包 咖啡 镜子 窗帘 小说 考试 医院 司机 客户 仓库 工厂 办公室 问卷 培训 安全 期限 质量 价格 折扣 保修 版本 翻译 录音 麦克风 摘要 建议 问题 答案 天气 夏天 周末 结果 原因 方法 规则 法律 经济 历史 科学 技术 研究 实验 调查 意见 决定 修理 检查 打扫 运动 比赛 舞台 照明 广播 节目 编辑 印刷 运输 库存 退货 温度 湿度 供水 电力 燃料 空气 森林 河流 海岸 动物 植物 蔬菜 水果 早餐 食堂 走廊 楼梯 停车场 窗口 地图 字幕 词汇 名单 日程 进度 责任 权限 演习 消防 健康 治疗 教育 招聘 面试 评价 广告 销售 利润 投资 贸易 进口 选举 申请 登记 更新 设计 开发 监控 故障 恢复 设备 空调 东楼 西门 标准 系统 数据 资料 费用 分配 安排 更换 重新 大约 预计 推迟 涉及",
    "unit_zh": "部 科 组 室 处 中心 团队 委员会 分店 小组", "lead_zh": "总之 顺便说 另外 首先 其次 最后 老实说 比如 备注 问题 一般来说 到目前为止 幸好 然后 照旧 换句话说 提醒 其实 当然 不过",
    "ja_sur": "青木 石渡 内海 榎本 大槻 風間 菊地 黒木 児玉 早乙女 篠宮 鈴村 関根 園田 高梨 月城 寺西 鳥越 成瀬 西園寺 布施 根本 野々村 橋爪 日向 藤代 逸見 堀越 真壁 三枝 向井 目黒 森脇 矢吹 湯浅 吉岡 若松 渡瀬 一ノ瀬 五百旗頭 四十万谷 勅使河原 長谷部 小鳥谷 神宮寺 九条 八木沢 万里小路 百目鬼 御手洗 久我山 二階堂 六車 七海 十文字",
    "ja_given": "太一 花子 美咲 翔 健 直樹 結衣 さくら あかり 大輔 千尋 純 薫 誠 由美子 孝之 朱里 蓮 陽菜 悠斗 和也 ひかる みどり 幸太郎 清 小夜子 忍 恵 航平 奈々 修造 慎一郎 咲 一馬 葵 つばさ",
    "ja_kana": "たかはし さとう ヤマモト コバヤシ いのうえ サイトウ なかむら マツダ おおつき ワタナベ たなか イシワタリ",
    "en_first": "Alice Brian Carol Derek Emily Frank Grace Harold Irene Jacob Karen Lewis Monica Norman Olivia Patrick Quentin Rachel Samuel Teresa Ursula Victor Wendy Xavier Yolanda Zachary Aisha Ravi Mei Fiona Liam Niamh",
    "en_last": "Abernathy Blackwood Cartwright Donnelly Ellsworth Fairbanks Goodwin Hathaway Ingleby Jefferson Kingsley Lancaster Montrose Northcott Osborne Pemberton Quigley Ravenhill Stapleton Thornbury Underhill Vandenberg Whitlock Yardley O'Brien McAllister Saint-Clair D'Arcy Mac-Donald Brown-Smith Takahashi Yamamoto Watanabe",
    "de_first": "Anna Bernd Claudia Dieter Elke Fritz Greta Heinz Ilse Jürgen Käthe Lothar Martina Norbert Petra Rüdiger Sabine Thorsten Uwe Walburga",
    "de_last": "Ackermann Bergstätter Dornbusch Eichinger Feldkirchner Großmann Hübschle Immelmann Jägerndorf Kühnhauser Löwenstein Mühlbacher Neureuther Pfefferkorn Rosenbaum Schönfelder",
    "es_first": "Lucía Javier Carmen Álvaro Beatriz Diego Elena Fernando Gloria Héctor Inés Joaquín",
    "es_last": "Montealegre Riosalido Castronuevo Fuenteclara Ibarguren Villacorta Zumárraga Piedrahita",
    "zh_sur": "赵 孙 周 吴 郑 冯 褚 卫 蒋 沈 韩 杨 朱 秦 许 何 吕 施 孔 曹 严 华 魏 陶 姜 公孙 轩辕 端木 东方 南宫 欧阳 上官 诸葛 慕容 夏侯 令狐 皇甫 王 李 张 刘 陈",
    "zh_char": "安 白 冰 博 采 辰 成 初 春 丹 德 东 恩 芳 菲 峰 歌 光 桂 国 海 涵 航 和 红 华 怀 慧 嘉 建 江 杰 洁 金 景 静 君 凯 岚 乐 黎 莉 林 玲 龙 鹿 明 宁 平 琪 青 秋 然 荣 瑞 若 珊 诗 舒 书 思 松 涛 天 桐 望 薇 伟 文 希 夏 欣 星 雪 雅 砚 遥 一 怡 义 英 宇 雨 玉 远 月 云 泽 知 志 子",
    "ja_char": "青赤秋朝安池石泉磯稲岩上宇梅江遠大岡奥尾折貝柏片金鎌上亀川河菊岸北木清日下久草倉栗黒桑小古郷越琴駒坂笹塩志柴島白杉須関瀬芹高滝竹立田谷玉千塚津月辻土常寺戸遠富友鳥中永夏波西沼野橋畑花浜早原春東平広深福藤船古星細堀本牧松丸三水道皆宮向村森八矢山結横吉若和渡鷹鴨猿鵜熊鹿鶴亀", "ja_end": "田川山野原本村島谷沢井口崎木林森岡塚池橋瀬坂宮畑浜沼江津戸見上下内部",
    "gi_char": "明彰朝亜愛綾安伊一逸詠恵英悦江円音央夏佳香和一克要環葵季希喜恭清久邦慶圭敬賢健航光浩幸紘紗咲貞怜里志茂修俊純順丈譲信真進澄星聖千晴大泰拓武猛忠達千恒哲照登透徳朋直尚伸典暢紀隼春治英久秀仁裕広寛史文芙穂誠正雅真政昌優松美瑞稔実宗恵元盛康靖雄由悠裕勇陽洋義佳良嘉利竜亮遼玲礼渉",
    "gi_end": "子美香奈恵江代乃里紀也哉太郎助介治司志之人吾朗平夫男雄彦輝樹生斗馬造二三織",
    "zh_given": "明轩 若兰 子涵 雨桐 志远 浩然 思源 嘉怡 晨曦 文博 静 磊",
    "pref": "緑野県 青葉県 星見県 花園県 北浜府 南雲府 白峰道 翠州都", "city": "朝日野市 松風市 千鳥市 若草市 西浜市 川辺町 山吹村 東雲市 中原区 大谷市", "block": "本町 栄町 緑が丘 中央 大手通 桜木町 北新地 富士見台 花見坂 泉小路 末広 美園 西原沢 上ノ浜", "flat": "メゾン青葉 コーポ富士 ハイツ桜 グランデ緑 パレス中央 サンハイム松",
    "street": "Maple|Highfield|Orchard|Saddler|Kingfisher|Bramble|Mill Pond|Old Church|St. Mary|Quarry|St. Clair|St. Edmund|St. Luke", "road": "Lane|Road|Street|Close|Row|Hill Ave.|Mews|Drive|Terrace|Way|Court", "town": "Ashbourne|Brookfield|Castleton|Lower Denby|Easthaven|Fordham Cross|Greywater|Hollowbridge",
    "strasse": "Lindenstraße|Gartenweg|Hohe Gasse|Am Neuen Markt|Rosenallee|Untere Gasse|Bergstraße|Birkenweg|Zum Alten Hafen|Mühlenplatz", "ort": "Altdorf|Neustadt-Süd|Sonnenberg|Grünwald|Kirchhausen",
    "calle": "del Olivo|de las Flores|Puente Viejo|de los Robles|del Mar Alto|Camino Verde", "pueblo": "Vallehermoso|Santa Luna|Puerto Claro del Río|Montesol",
    "zh_pref": "青山省 白云省 星海省", "zh_city": "明珠市 东湖市 南岭市 西川市", "zh_road": "长安路 和平街 桃花巷 解放路 新华街",
    "month": "January February March April May June July August September October November December",
    "group": "放送部 園芸係 町内会 図書室 編集班 飼育係 第二工場 給食室 写真部 自治会 測量隊 合唱団", "group_en": "the choir|the garden club|the bakery|the night crew|the library|the front row|the orchestra|the editors", "topic_ja": "かぼちゃの煮物|赤い自転車|古いピアノ|誕生日の贈り物|釣り船|青いカーテン|雪かきの道具|紙の提灯|将棋盤|庭のホース|焼き芋|夏みかん|毛糸の帽子|ガラスの皿|竹の椅子",
    "topic_en": "umbrella|pumpkin soup|red bicycle|garden hose|old piano|birthday present|fishing boat|blue curtain|coffee machine|snow shovel|paper lantern|chess board", "topic_de": "Kürbissuppe|Gartenschlauch|Regenschirm|Klavierstuhl|Schneeschaufel|Papierlaterne|Angelboot|Vorhang", "topic_es": "paraguas|bicicleta roja|piano viejo|regalo|sopa de calabaza|barca|farol de papel", "topic_zh": "南瓜汤|红自行车|旧钢琴|生日礼物|渔船|蓝窗帘|纸灯笼|象棋|毛线帽|玻璃盘子",
    "firm_ja": "青空商事 みどり電機 北山工業 星光フーズ 山川印刷", "firm_en": "Acme Tools|Northwind Foods|Kitayama Kogyo|Aozora Shoji",
    "user": "ken77.z9 kyoko88 m31.x2 jane tom.baker s_ito mika77 front-desk.lee a.k.b bob hiroko q_roy", "host": "example.net mail.example.jp news.sample.org corp.invalid lab.test shop-c.example.co",
}
LISTS = {k: v.split("|") if "|" in v else v.split() if " " in v else list(v) for k, v in _W.items()}
LISTS["link_zh"].append("")

_WIDE = str.maketrans("0123456789-()", "０１２３４５６７８９－（）")
_HAN = str.maketrans("0123456789", "〇一二三四五六七八九")
_WORDS = "zero one two three four five six seven eight nine".split()


class Filler:
    """Random fillings of the slots."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def one(self, key: str) -> str:
        return self.r.choice(LISTS[key])

    def digits(self, *groups: int, sep: str = "-") -> str:
        return sep.join("".join(self.r.choice("0123456789") for _ in range(n)) for n in groups)

    def pick(self, *options):
        return self.r.choice(options)()

    def fill(self, slot: str) -> str:
        return getattr(self, slot)()

    def surname(self) -> str:
        """A surname of the list, or one made of characters that surnames are written with."""
        part = lambda: self.one("ja_char")
        return self.pick(lambda: self.one("ja_sur"), lambda: part() + self.one("ja_end"), lambda: part() + part() + self.one("ja_end"), lambda: part() + part(), lambda: part() + self.r.choice("ノのヶ之") + self.one("ja_end"), lambda: part() + "の" + self.one("ja_end"), lambda: part() + part() + part() + self.one("ja_end"))

    def given(self) -> str:
        part = lambda: self.one("gi_char")
        return self.pick(lambda: self.one("ja_given"), lambda: part() + self.one("gi_end"), part, lambda: part() + part(), lambda: part() + "太郎", lambda: "".join(self.r.choice("あいうかきくけこさしすせたちつとなにのはひふほまみめもやゆよりるれわん") for _ in range(3)))

    def kana_name(self) -> str:
        sounds = "アイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワガギグゴザジズダデドバビブベボン"
        word = lambda n: self.r.choice(sounds[:-1]) + "".join(self.r.choice(sounds) for _ in range(n))
        a, b = word(self.r.randint(2, 5)), word(self.r.randint(1, 4))
        text = self.pick(lambda: f"{a} {b}", lambda: f"{a}・{b}", lambda: a + b, lambda: a)
        return text if self.r.random() < 0.5 else "".join(chr(ord(c) - 0x60) if "ァ" <= c <= "ヶ" else c for c in text)

    def ro_name(self) -> str:
        """A Japanese name in Latin letters."""
        syllable = lambda: self.r.choice(("", *"kstnhmyrgzdb")) + self.r.choice("aiueo")
        s, g = ("".join(syllable() for _ in range(n)).capitalize() for n in (self.r.randint(3, 6), self.r.randint(2, 4)))
        return self.pick(lambda: f"{s} {g}", lambda: f"{g} {s}", lambda: f"{g[0]}. {s}", lambda: f"{s.upper()}, {g}", lambda: s)

    def any_name(self) -> str:
        f, l = self.one("en_first"), self.one("en_last")
        return self.pick(self.ja_name, self.ja_name, self.kana_name, self.ro_name, self.en_name, self.en_name, self.de_name, lambda: f"{l.upper()} {f}", lambda: f"{l}, {f}", lambda: f"{f[:3]}. {l}", lambda: f"{f} {l}".lower(), lambda: self.ro_name().replace(" ", "").lower())

    def es_phone(self) -> str:
        a, b, c = self.digits(3), self.digits(3), self.digits(3)
        return self.pick(lambda: f"{a} {b} {c}", lambda: f"{a}.{b}.{c}", lambda: f"(+34) {a}{b}{c}", lambda: f"+34 {a} {b} {c}", lambda: f"{a} {b[:2]} {c[:2]} {self.digits(2)}", lambda: f"0034 {a} {b} {c}")

    def ja_name(self) -> str:
        s, g, k = self.surname(), self.given(), self.kana_name()
        return self.pick(lambda: s + g, lambda: f"{s} {g}", lambda: s, lambda: s + g, lambda: f"{s}　{g}", lambda: k, lambda: k, lambda: s)

    def _latin(self, first: str, last: str) -> str:
        f, l = self.one(first), self.one(last)
        m = self.r.choice("ABCDEFGHJKLMRSTW")
        return self.pick(lambda: f"{f} {l}", lambda: f"{f} {l}", lambda: f"{f[0]}. {l}", lambda: f"{f} {m}. {l}", lambda: f"{l} {f}", lambda: f"{f} {l}")

    def en_name(self) -> str:
        return self._latin("en_first", "en_last")

    def de_name(self) -> str:
        name = self._latin("de_first", "de_last")
        return name if self.r.random() < 0.75 else f"{self.one('de_first')} {self.r.choice(('von', 'van der', 'zu', 'von der'))} {self.one('de_last')}"

    def es_name(self) -> str:
        return self._latin("es_first", "es_last")

    def zh_name(self) -> str:
        return self.one("zh_sur") + self.pick(lambda: self.one("zh_given"), lambda: self.one("zh_char") + self.one("zh_char"), lambda: self.one("zh_char") + self.one("zh_char"), lambda: self.one("zh_char"))

    def ja_phone(self) -> str:
        a = self.r.choice(("03", "06", "03", "06", "045", "0799", "0799", "090", "080", "070", "052"))
        b, c = self.digits(4), self.digits(4)
        return self.pick(
            lambda: f"{a}-{b}-{c}", lambda: f"{a}{b}{c}", lambda: f"{a}{b}{c}", lambda: f"{a} {b} {c}", lambda: f"{a}({b}){c}", lambda: f"{a}-{b}-{c}".translate(_WIDE), lambda: f"({a}){b}-{c}".translate(_WIDE),
            lambda: f"+81-{a[1:]}-{b}-{c}", lambda: f"+81 {a[1:]} {b} {c}", lambda: "の".join((a, b, c)).translate(_HAN), lambda: "の".join((a, b, c)).translate(_HAN),
        )

    def en_phone(self) -> str:
        a, b, c = self.digits(3), self.digits(3), self.digits(4)
        words = " ".join(_WORDS[int(d)] for d in b) + ", " + " ".join(_WORDS[int(d)] for d in c)
        return self.pick(lambda: f"{a}-{b}-{c}", lambda: f"({a}) {b}-{c}", lambda: f"{a}.{b}.{c}", lambda: f"1-{a}-{b}-{c}", lambda: f"+1 {a} {b} {c}", lambda: f"020 {self.digits(4)} {c}", lambda: f"020 {self.digits(4)} {c}", lambda: words, lambda: f"+44 20 {self.digits(4)} {c}")

    def de_phone(self) -> str:
        a, b, c = self.r.choice(("030", "040", "089")), self.digits(5), self.digits(3)
        return self.pick(lambda: f"{a} {b} {c}", lambda: f"({a}) {b}{c}", lambda: f"+49 {a[1:]} {b}-{c}", lambda: f"0049/{a[1:]}/{b}{c}", lambda: f"{a}/{b}{c}", lambda: f"+34 9{self.digits(2)} {self.digits(3)} {c}", lambda: f"(+34) 9{self.digits(2)} {self.digits(2, 2, 2, sep=' ')}", lambda: f"9{self.digits(2)} {self.digits(3, 3, sep=' ')}")

    def zh_phone(self) -> str:
        m = "1" + self.digits(10)
        return self.pick(lambda: m, lambda: f"+86 {m}", lambda: f"0{self.digits(3)}-{self.digits(8)}", lambda: m.translate(_WIDE), lambda: f"{m[:3]} {m[3:7]} {m[7:]}")

    def email(self) -> str:
        u = self.one("user") + self.pick(lambda: "", lambda: self.digits(2), lambda: "+memo", lambda: ".x" + self.digits(1))
        h = self.one("host")
        return self.pick(
            lambda: f"{u}@{h}", lambda: f"{u}@{h}", lambda: f"{u}@{h}".upper(), lambda: f"{u}＠{h}", lambda: f"{u} [at] {h}", lambda: f"{u}(at){h.replace('.', ' dot ')}",
            lambda: f"{u.replace('.', 'ドット')}アットマーク{h.replace('.', 'ドット')}", lambda: f"{u} at {h.replace('.', ' dot ')}",
        )

    def ja_id(self) -> str:
        d = self.digits(12)
        return self.pick(lambda: self.digits(4, 4, 4), lambda: self.digits(4, 4, 4, sep=" "), lambda: d, lambda: d.translate(_WIDE), lambda: self.r.choice(("TZ", "MK", "AB")) + self.digits(7), lambda: f"{self.digits(2)}・{self.digits(6)}", lambda: self.digits(2, 6))

    def en_id(self) -> str:
        return self.pick(lambda: f"9{self.digits(2)}-{self.digits(2, 4)}", lambda: f"9{self.digits(2)} {self.digits(2, 4, sep=' ')}", lambda: f"QZ{self.digits(6)}B", lambda: f"X{self.digits(7)}Q", lambda: f"L0{self.digits(2)}XC{self.digits(4)}", lambda: f"C{self.digits(2)}XK{self.digits(4)}", lambda: f"{self.r.choice('KPYZ')}{self.digits(7)}{self.r.choice('RSTW')}")

    def es_id(self) -> str:
        c = self.r.choice("TRWAGMYFPDX")
        return self.pick(lambda: f"{self.digits(2, 3, 3, sep='.')}-{c}", lambda: f"{self.digits(8)}{c}", lambda: f"{self.r.choice('XYZ')}{self.digits(7)}{c}")

    def zh_id(self) -> str:
        return self.digits(17) + self.r.choice("0123456789X")

    def ja_address(self) -> str:
        n = lambda: str(self.r.randint(1, 29))
        a, b, c = n(), n(), n()
        num = self.pick(lambda: f"{a}-{b}-{c}", lambda: f"{a}丁目{b}番{c}号", lambda: f"{a}丁目{b}-{c}", lambda: f"{a}ー{b}ー{c}".translate(_WIDE), lambda: f"{a}の{b}".translate(_HAN), lambda: f"{a}番地{b}", lambda: f"{a}－{b}－{c}".translate(_WIDE))
        flat = self.pick(lambda: "", lambda: "", lambda: f" {self._flat()}{self.digits(3)}", lambda: f" {self._flat()}{self.digits(3)}", lambda: f"　{self._flat()}{self.digits(3)}号室")
        return self.pick(lambda: self.one("pref"), lambda: self.one("pref"), lambda: "") + self.one("city") + self.one("block") + num + flat

    def _flat(self) -> str:
        """A house with a name."""
        c = lambda: self.one("ja_char")
        return self.pick(lambda: self.one("flat"), lambda: c() + c() + self.r.choice(("ハイツ", "マンション", "コーポ", "荘", "ハウス", "団地")), lambda: self.r.choice(("メゾン", "コーポ", "グランド", "ヴィラ", "レジデンス", "シャトー")) + self.r.choice(("", c(), c() + c())))

    def _town(self) -> str:
        """A town, in one word or two."""
        return self.pick(lambda: self.one("town"), lambda: f"{self.r.choice(('Upper', 'Lower', 'Great', 'Little', 'North', 'New', 'Old', 'St.'))} {self.one('en_last')}", lambda: f"{self.one('en_last')} {self.r.choice(('Cross', 'Green', 'Heath', 'Bridge', 'End', 'Mill', 'Bay'))}")

    def en_address(self) -> str:
        n = str(self.r.randint(1, 2999))
        s = f"{n} {self.one('street')} {self.one('road')}"
        return self.pick(lambda: s, lambda: f"{s}, {self._town()}", lambda: f"{s}, Apt {self.r.randint(1, 9)}{self.r.choice('ABCD')}, {self._town()}", lambda: f"Flat {self.r.randint(1, 9)}, {s}, {self._town()}", lambda: f"{s}, Apt {self.r.randint(1, 9)}{self.r.choice('ABCD')}")

    def de_address(self) -> str:
        s = f"{self.one('strasse')} {self.r.randint(1, 30)}{self.r.choice(('', '', 'a', 'b', 'c'))}"
        return self.pick(lambda: s, lambda: f"{s}, {self.one('ort')}", lambda: f"{s}, {self.digits(5)} {self.one('ort')}")

    def es_address(self) -> str:
        s = f"{self.r.choice(('Calle', 'Avda.', 'C/', 'Plaza'))} {self.one('calle')} {self.r.randint(1, 30)}"
        return self.pick(lambda: s, lambda: f"{s}, {self.r.randint(1, 5)}.º {self.r.choice('ABCD')}", lambda: f"{s}, {self.one('pueblo')}")

    def zh_address(self) -> str:
        n = lambda: str(self.r.randint(1, 30))
        tail = self.pick(lambda: "", lambda: f"{n()}单元{self.digits(4)}室", lambda: f"{n()}栋{n()}楼", lambda: f"{n()}单元{self.digits(3)}室")
        return self.pick(lambda: self.one("zh_pref"), lambda: "") + self.one("zh_city") + self.one("zh_road") + n() + "号" + tail

    def _n(self) -> str:
        """Something that Japanese has a common word for, or two of them."""
        n, k = lambda: self.one("noun_ja"), lambda: self.one("kata")
        return self.pick(n, n, k, lambda: n() + n(), lambda: n() + n(), lambda: f"{n()}の{n()}", lambda: f"{k()}の{n()}", lambda: k() + n(), lambda: n() + k(), lambda: f"新しい{n()}", lambda: f"{n()}の{n()}の{n()}")

    def _g(self) -> str:
        n = lambda: self.one("noun_ja")
        return self.pick(lambda: n() + self.one("unit"), lambda: n() + self.one("unit"), lambda: n() + n() + self.one("unit"), lambda: f"第{self.r.choice('一二三四五123')}{n()}{self.one('unit')}", lambda: self.one("kata") + self.one("unit"), lambda: self.one("group"))

    def _e(self) -> str:
        n = lambda: self.one("noun_en")
        return self.pick(n, n, lambda: f"{n()} {n()}", lambda: f"{self.one('adj_en')} {n()}", lambda: f"{self.one('adj_en')} {n()} {n()}")

    def _d(self) -> str:
        n = lambda: self.one("noun_de")
        return self.pick(n, n, n, lambda: f"{n()} der {n()}", lambda: f"{n()} im {n()}")

    def _s(self) -> str:
        n = lambda: self.one("noun_es")
        return self.pick(n, n, n, lambda: f"{n()} de la {n()}", lambda: f"{n()} del {n()}")

    def _z(self) -> str:
        n = lambda: self.one("noun_zh")
        return self.pick(n, n, lambda: n() + n(), lambda: n() + n(), lambda: n() + n() + n(), lambda: f"{n()}的{n()}")

    def _gz(self) -> str:
        return self.pick(lambda: self.one("noun_zh") + self.one("unit_zh"), lambda: f"第{self.r.choice('一二三四五')}{self.one('noun_zh')}{self.one('unit_zh')}")

    def _num(self) -> str:
        return str(self.r.choice((self.r.randint(1, 31), self.r.randint(1, 999), self.r.randint(1, 9))))

    def _month_n(self) -> str:
        return str(self.r.randint(1, 12))

    def _room(self) -> str:
        n = str(self.r.randint(1, 20))
        return "-".join((n, n, n))

    def _slip(self) -> str:
        return self.digits(3, 4)

    def _order(self) -> str:
        return self.pick(lambda: self.digits(4, 4, 4, sep=" "), lambda: self.digits(12))

    def _part(self) -> str:
        return f"0{self.digits(1)}-{self.digits(4)}-{self.r.choice(('AB', 'CX', 'KL'))}"

    def _date(self) -> str:
        return f"202{self.digits(1)}-{self.r.randint(10, 12)}-{self.r.randint(10, 28)}"

    def _time(self) -> str:
        return "10:30-12:45"

    def _ticket(self) -> str:
        return self.r.choice("QRSTK") + self.r.choice(("", "-")) + self.digits(6)

    def __getattr__(self, name: str):
        key = name.lstrip("_")
        if key in LISTS:
            return lambda: self.one(key)
        raise AttributeError(name)


def labelled(copies: int = 10, seed: int = 20, chosen: Callable[[str], bool] = lambda sentence: True) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """(text, mentions as start, end, kind): every chosen sentence `copies` times (those without a mention half as often), alone or behind others."""
    filler = Filler(seed)
    pool = [s for s in SENTENCES if chosen(s) for _ in range(copies)] + [s for s in PLAIN if chosen(s) for _ in range((copies + 1) // 2)]
    filler.r.shuffle(pool)
    out, text, spans = [], "", []
    for sentence in pool:
        at = 0
        text += filler.r.choice(LEADS) if filler.r.random() < 0.2 else ""
        if filler.r.random() < 0.1 and not text.strip():  # the label of the speaker
            sentence = filler.r.choice(("{any_name}", "{ja_name}", "{en_name}")) + filler.r.choice(("：", ": ", "＞", " : ", "： ", "> ")) + sentence
        while at < len(sentence):
            if sentence[at] == "{":
                stop = sentence.index("}", at)
                slot = sentence[at + 1 : stop]
                value = filler.fill(slot)
                if not slot.startswith("_"):
                    spans.append((len(text), len(text) + len(value), slot.split("_")[-1] if slot != "email" else "email"))
                text += value
                at = stop + 1
            else:
                text += sentence[at]
                at += 1
        if filler.r.random() < 0.6:
            out.append((text, [(a, b, {"id": "id_number"}.get(k, k)) for a, b, k in spans]))
            text, spans = "", []
        else:
            text += filler.r.choice(("", " ", "\n", "　", "・")) if sentence[-1] in "。！？" else " "
    if text:
        out.append((text, [(a, b, {"id": "id_number"}.get(k, k)) for a, b, k in spans]))
    return out
